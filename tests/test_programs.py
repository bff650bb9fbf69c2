"""Whole programs over files: exact output bytes, policies, provenance, encryption and workbooks."""

import base64
import zipfile

import pytest

from tidegate.nodes import BuildFault, FatalFault, RowFault
from tidegate.run import run_text


@pytest.fixture()
def go(spark, tmp_path):
    def run(program, files, *outputs):
        for name, text in files.items():
            (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
        run_text(spark, program, str(tmp_path))
        got = [(tmp_path / o).read_text() for o in (outputs or ["out.jsonl"])]
        return got[0] if len(got) == 1 else got

    return run


OUT = 'sink out = jsonl("out.jsonl")\n'


def test_filter_map_numbers(go):
    program = 'source in = csv("a.csv", schema: { berth: string, draught: int, fee: double })\n' + OUT + "pipeline main { in |> filter(.draught < 9) |> map({ ...row, berth: lower(.berth), cheap: .fee <= 12.5, double: .draught * 2 }) |> out }"
    got = go(program, {"a.csv": "draught,berth,fee\n3,NORTH,12.5\n11,QUAY,1\n8,<Mole>,70\n"})
    assert got == '{"berth":"north","draught":3,"fee":12.5,"cheap":true,"double":6}\n{"berth":"\\u003cmole\\u003e","draught":8,"fee":70,"cheap":false,"double":16}\n'


def test_select_rename_drop_slice(go):
    files = {"a.csv": "tide,hull,x\n" + "".join(f"{i},h{i},{i * i}\n" for i in range(6))}
    program = 'source in = csv("a.csv", schema: { tide: int, hull: string, x: int })\n' + OUT + "pipeline main { in |> offset(3) |> limit(2) |> rename(tide: hull, hull: tide) |> drop(x) |> select(tide, hull) |> out }"
    assert go(program, files) == '{"tide":"h3","hull":3}\n{"tide":"h4","hull":4}\n'


LOG = 'source log = csv("log.csv", schema: { ship: string, knots: int, port: string })\n' + OUT
VOYAGES = {"log.csv": "ship,knots,port\nGannet,12,Oban\nTern,0,Leith\nFulmar,9,Wick\nSkua,0,Mallaig\nPetrel,15,Troon\n"}
CHECK = 'pipeline main { log |> check(.knots > 0, "lies still") |> out }'


def test_abort_writes_the_rows_before(go, tmp_path):
    with pytest.raises(RowFault, match='row 1 from "log": lies still'):
        go(LOG + CHECK, VOYAGES)
    assert (tmp_path / "out.jsonl").read_text() == '{"ship":"Gannet","knots":12,"port":"Oban"}\n'


def test_skip_and_route(go):
    assert go("on error skip\n" + LOG + CHECK, VOYAGES).count("\n") == 3
    out, bad = go('on error |> errors\nsink errors = jsonl("bad.jsonl")\n' + LOG + CHECK, VOYAGES, "out.jsonl", "bad.jsonl")
    assert out.count("\n") == 3
    assert bad.splitlines() == [f'{{"source":"log","ordinal":{n},"offset":{n + 2},"reason":"lies still","stage":"check"}}' for n in (1, 3)]


def test_bad_cells_and_limit_counts_them(go):
    program = 'on error |> errors\nsink errors = jsonl("bad.jsonl")\n' + LOG + "pipeline main { log |> limit(2) |> out }"
    out, bad = go(program, {"log.csv": "ship,knots,port\n\nTern,4x,Leith\nSkua,2,Wick\nPetrel,3,Troon\n"}, "out.jsonl", "bad.jsonl")
    assert out == '{"ship":"Skua","knots":2,"port":"Wick"}\n'
    assert bad == '{"source":"log","ordinal":0,"offset":3,"reason":"cannot parse \\"4x\\" as int","stage":"csv:knots"}\n'


def test_personal_cells_stay_out_of_reasons(go):
    program = 'on error |> errors\nsink errors = jsonl("bad.jsonl")\nsource in = csv("a.csv", schema: { id: int, age: int @pii })\n' + OUT + "pipeline main { in |> drop(age) |> out }"
    _, bad = go(program, {"a.csv": "id,age\n1,secret\n"}, "out.jsonl", "bad.jsonl")
    assert "secret" not in bad and "cannot parse cell as int" in bad


def test_broken_record_is_fatal_under_any_policy(go, tmp_path):
    with pytest.raises(FatalFault, match="line 3"):
        go("on error skip\n" + LOG + "pipeline main { log |> out }", {"log.csv": "ship,knots,port\nTern,1,Wick\nSkua,2\nAuk,3,Wick\n"})
    assert (tmp_path / "out.jsonl").read_text() == '{"ship":"Tern","knots":1,"port":"Wick"}\n'


def test_quotes_line_breaks_and_chunks(spark, tmp_path):
    from tidegate.analyze import source_schema
    from tidegate.builder import fields
    from tidegate.nodes import SourceDecl
    from tidegate.sources.csv import csv_source

    lines = ["id,note"]
    for i in range(200):
        lines.append(f'{i},"a ""q"" {i}\n\nend, {i}"' if i % 3 else f"{i},plain")
        if i % 7 == 0:
            lines.append("")
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    decl = SourceDecl("in", "csv", "a.csv", fields("id: int, note: string"))
    results = []
    for chunk in (37, 256, 1 << 20):
        f = csv_source(spark, decl, source_schema(decl), str(tmp_path), chunk)
        results.append(sorted(tuple(r) for r in f.df.select("`#ord`", "`#off`", "s0", "s1").collect()))
    assert results[0] == results[1] == results[2]
    assert [r[0] for r in results[0]] == [r[2] for r in results[0]] == list(range(200))
    assert results[0][1][3] == 'a "q" 1\n\nend, 1'
    assert results[0][0][1] == 2 and results[0][1][1] == 4


def test_decimals_keep_their_scale(go):
    program = 'source in = csv("a.csv", schema: { lot: int, tonnes: decimal, loss: decimal })\n' + OUT + "pipeline main { in |> map({ ...row, levy: .tonnes * 0.125, left: .tonnes - .loss, each: .tonnes / 7, heavy: .tonnes > 2500 }) |> out }"
    got = go(program, {"a.csv": 'lot,tonnes,loss\n8,41.30,0.2\n5,"7,250.0",3\n2,-0.006,2e2\n'})
    assert got.splitlines() == [
        '{"lot":8,"tonnes":41.30,"loss":0.2,"levy":5.16250,"left":41.10,"each":5.9000000000000000,"heavy":false}',
        '{"lot":5,"tonnes":7250.0,"loss":3,"levy":906.2500,"left":7247.0,"each":1035.7142857142857143,"heavy":true}',
        '{"lot":2,"tonnes":-0.006,"loss":200,"levy":-0.000750,"left":-200.006,"each":-0.0008571428571429,"heavy":false}',
    ]


def test_dates_and_moments(go):
    program = 'on error skip\nsource in = csv("a.csv", schema: { a: date, b: date, t: datetime }, formats: { b: "02/01/2006", t: "2006-01-02 15:04:05" })\n' + OUT + "pipeline main { in |> filter(.a < .b) |> out }"
    got = go(program, {"a.csv": "a,b,t\n2026-01-05,06/01/2026,2026-03-08 02:30:00\n2026-1-5,06/01/2026,2026-03-08 02:30:00\n2026-01-05,31/02/2026,2026-03-08 02:30:00\n2026-01-05,05/01/2026,2026-03-08 02:30:00\n"})
    assert got == '{"a":"2026-01-05","b":"2026-01-06","t":"2026-03-08T02:30:00"}\n'


def test_optional_and_aliases(go):
    program = 'source in = csv("a.csv", schema: { n: string, phone: string?, gone: int? }, columns: { n: "Full Name" })\n' + OUT + 'pipeline main { in |> map({ n: .n, phone: .phone ?? "n/a", gone: (.gone + 1) ?? 7 }) |> out }'
    assert go(program, {"a.csv": "phone,Full Name\n 1,A\n  ,B\n"}) == '{"n":"A","phone":" 1","gone":7}\n{"n":"B","phone":"n/a","gone":7}\n'
    with pytest.raises(BuildFault, match='required column "Full Name" not found'):
        go(program, {"a.csv": "phone\n1\n"})


def test_route_and_broadcast(go):
    program = 'source in = csv("a.csv", schema: { hull: string, captain: string @pii, tons: int })\nsink heavy = jsonl("out.jsonl")\nsink light = jsonl("rest.jsonl")\n'
    files = {"a.csv": "hull,captain,tons\nTern,Ås,900\nSkua,Bo,20\nAuk,Cy,300\n"}
    heavy, light = go(program + "pipeline main { in |> mask(captain) |> route { .tons > 500 => heavy, .tons < 50 => discard, else => light } }", files, "out.jsonl", "rest.jsonl")
    assert heavy == '{"hull":"Tern","captain":"***","tons":900}\n' and light == '{"hull":"Auk","captain":"**","tons":300}\n'
    heavy, light = go(program + "pipeline main { in |> redact(captain) |> heavy, light }", files, "out.jsonl", "rest.jsonl")
    assert heavy == light and heavy.count("[REDACTED]") == 3


def test_segments(go):
    program = 'source in = csv("a.csv", schema: { hull: string, tons: int, mate: string @pii, cook: string @pii })\n' + OUT + "pipeline hide(who) = map({ ...row, who: mask(.who) })\npipeline least(n: int) = filter(.tons >= n)\npipeline main { in |> hide(mate) |> hide(cook) |> least(100) |> out }"
    assert go(program, {"a.csv": "hull,tons,mate,cook\nTern,900,ab,abcd\nSkua,3,x,y\n"}) == '{"hull":"Tern","tons":900,"mate":"**","cook":"****"}\n'


def test_encryption(go, spark, monkeypatch):
    key = bytes(range(32))
    program = 'source in = csv("a.csv", schema: { id: int, a: string @deidentify, b: int? @deidentify, c: string @deidentify }, key: env("TG_TEST_KEY"))\n' + OUT + 'sink two = jsonl("two.jsonl")\npipeline main { in |> out, two }'
    files = {"a.csv": "id,a,b,c\n1,x,5,x\n2,x,,x\n"}
    with pytest.raises(BuildFault, match="is not set"):
        go(program, files)
    monkeypatch.setenv("TG_TEST_KEY", "00")
    with pytest.raises(BuildFault, match="32 bytes"):
        go(program, files)
    monkeypatch.setenv("TG_TEST_KEY", key.hex())
    one, two = go(program, files, "out.jsonl", "two.jsonl")
    assert one == two
    import json

    rows = [json.loads(x) for x in one.splitlines()]
    cells = [r[c] for r in rows for c in "abc"]
    assert len(set(cells)) == 6
    plain = [bytes(spark.sql(f"select aes_decrypt(unbase64('{c}'), unhex('{key.hex()}'), 'GCM')").first()[0]) for c in cells]
    assert plain == [b"\x01x", b"\x015", b"\x01x", b"\x01x", b"\x00", b"\x01x"]
    assert len(base64.b64decode(cells[0])) == 12 + 2 + 16


def workbook(path, rows, sheet="People"):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = lambda n, r: "".join(f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + i)}{n}"><v>{v}</v></c>' for i, v in enumerate(r) if v is not None)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{n}">{cells(n, r)}</row>' for n, r in rows) + "</sheetData></worksheet>")


def test_workbooks(go, tmp_path):
    workbook(tmp_path / "h.xlsx", [(1, ["harbour list"]), (2, ["hull", "tons"]), (3, ["Tern", 900]), (5, [None, None, "note"]), (6, ["Skua", "many"]), (7, ["Auk"])], "Hulls")
    program = 'on error |> errors\nsink errors = jsonl("bad.jsonl")\nsource in = xlsx("h.xlsx", sheet: "Hulls", header_row: 2, schema: { hull: string, tons: int })\n' + OUT + "pipeline main { in |> out }"
    out, bad = go(program, {}, "out.jsonl", "bad.jsonl")
    assert out == '{"hull":"Tern","tons":900}\n'
    assert bad.splitlines() == ['{"source":"in","ordinal":1,"offset":6,"reason":"cannot parse \\"many\\" as int","stage":"xlsx:tons"}', '{"source":"in","ordinal":2,"offset":7,"reason":"cannot parse \\"\\" as int","stage":"xlsx:tons"}']
    for change, part in (('sheet: "Hulls"', 'sheet "Other" not found; available: Hulls'), ("header_row: 2", "header_row must be 1 or more"), ("tons: int }", "required column")):
        new = {'sheet: "Hulls"': 'sheet: "Other"', "header_row: 2": "header_row: 0", "tons: int }": "nope: int }"}[change]
        with pytest.raises(BuildFault, match=part):
            go(program.replace(change, new), {})


def test_unknown_formats_and_division(go):
    with pytest.raises(BuildFault, match="no source format"):
        go('source in = yaml("a", schema: { a: int })\n' + OUT + "pipeline main { in |> out }", {})
    program = 'source in = csv("a.csv", schema: { a: int, b: int, x: double, y: double })\n' + OUT
    files = {"a.csv": "a,b,x,y\n-7,2,1,4\n9223372036854775807,1,1e21,1e-7\n"}
    got = go(program + "pipeline main { in |> map({ q: .a / .b, s: .a + .b, x: .x, z: .x / .y }) |> out }", files)
    assert got == '{"q":-3,"s":-5,"x":1,"z":0.25}\n{"q":9223372036854775807,"s":-9223372036854775808,"x":1e+21,"z":1e+28}\n'
    with pytest.raises(Exception, match="divide by zero"):
        go(program + "pipeline main { in |> map({ q: .a / 0 }) |> out }", files)
    with pytest.raises(Exception, match="not a finite number"):
        go(program + "pipeline main { in |> map({ z: .x / 0.0 }) |> out }", files)


def test_console(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("a\n1\n2\n")
    run_text(spark, 'source in = csv("a.csv", schema: { a: int })\nsink out = jsonl("never.jsonl")\npipeline main { in |> out }', str(tmp_path), to_console=True)
    assert capsys.readouterr().out == '=== out ===\n{"a":1}\n{"a":2}\n'
    assert not (tmp_path / "never.jsonl").exists()


def test_ranges_without_quotes(spark, tmp_path):
    """Ranges split column-wise give what ranges read record by record give, whatever ends the lines."""
    from tidegate.analyze import source_schema
    from tidegate.builder import fields
    from tidegate.nodes import SourceDecl
    from tidegate.sources.csv import csv_source

    lines = ["id,note"]
    for i in range(300):
        lines.append(f"{i},é{i}" + ("\r" if i % 5 == 0 else "") if i % 50 else f'{i},"x, {i}"')
        if i % 9 == 0:
            lines.append("")
    for end in ("\n", ""):
        (tmp_path / "a.csv").write_bytes(("\n".join(lines) + end).encode())
        decl = SourceDecl("in", "csv", "a.csv", fields("id: int, note: string"))
        got = [sorted(tuple(r) for r in csv_source(spark, decl, source_schema(decl), str(tmp_path), chunk).df.select("`#ord`", "`#off`", "s0", "s1").collect()) for chunk in (41, 300, 1 << 20)]
        assert got[0] == got[1] == got[2] and [r[0] for r in got[0]] == [r[2] for r in got[0]] == list(range(300))
        assert got[0][7][3] == "é7" and got[0][5][3] == "é5" and got[0][50][3] == "x, 50"


def test_jsonl_folder_in_row_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("hull\n" + "".join(f"h{i:03}\n" for i in range(500)))
    run_text(spark, 'source in = csv("a.csv", schema: { hull: string })\nsink out = jsonl("lines/")\npipeline main { in |> out }', str(tmp_path))
    parts = sorted(p for p in (tmp_path / "lines").iterdir() if p.name.startswith("part-"))
    assert "".join(p.read_text() for p in parts) == "".join(f'{{"hull":"h{i:03}"}}\n' for i in range(500))


@pytest.mark.parametrize("path", ["logs/a*.csv", "logs", "file://{base}/logs", "file://{base}/logs/a?.csv"])
def test_several_files(spark, tmp_path, path):
    """A folder or pattern: ordinals go on, line numbers begin anew, and every header must be the same."""
    from tidegate.analyze import source_schema
    from tidegate.builder import fields
    from tidegate.nodes import SourceDecl
    from tidegate.sources.csv import csv_source

    (tmp_path / "logs").mkdir()
    for n, rows in ((1, ["10,x", '11,"y\n,z"', "", "12,w"]), (2, ["20,x"]), (3, []), (4, ["40,q", "41,r"])):
        (tmp_path / "logs" / f"a{n}.csv").write_text("\n" * (n == 4) + "id,note\n" + "".join(r + "\n" for r in rows))
    (tmp_path / "logs" / "_done").write_text("")
    decl = SourceDecl("in", "csv", path.replace("{base}", str(tmp_path)), fields("id: int, note: string"))
    for chunk in (9, 1 << 20):
        f = csv_source(spark, decl, source_schema(decl), str(tmp_path), chunk)
        assert sorted(tuple(r) for r in f.df.select("`#ord`", "`#off`", "s0", "s1").collect()) == [(0, 2, 10, "x"), (1, 3, 11, "y\n,z"), (2, 6, 12, "w"), (3, 2, 20, "x"), (4, 3, 40, "q"), (5, 4, 41, "r")]
    (tmp_path / "logs" / "a5.csv").write_text("note,id\nx,1\n")
    with pytest.raises(BuildFault, match="not that of the first file"):
        csv_source(spark, decl, source_schema(decl), str(tmp_path), 9)
    with pytest.raises(BuildFault, match="no file found"):
        csv_source(spark, SourceDecl("in", "csv", "none*.csv", fields("id: int")), source_schema(decl), str(tmp_path))
