"""Operators over whole tables that go beyond row pipelines."""
