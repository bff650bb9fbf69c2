import sys

from tidegate.cli import main

sys.exit(main())
