import json
import os
import stat
import threading

import pytest

from leafseek import api, cli
from leafseek.errors import LeafseekError
from leafseek.plans import artifacts
from leafseek.sources import layout
from leafseek.sources.jsonio import json_string, parse_json
from leafseek.tools import ToolRunner, run_tool

LAYOUT = '<page width="612" height="792"><line><word xMin="1" yMin="2" xMax="3" yMax="4">Supply</word> <word xMin="" yMin="2" xMax="3" yMax="4">ch&amp;in-</word></line><line><word xMin="5" yMin="6" xMax="7" yMax="8">resilience</word></line></page><page width="612" height="792"></page>'


@pytest.fixture
def tools(tmp_path, monkeypatch):
    """Stand-ins for the PDF tools, which print fixed outputs."""
    folder = tmp_path / "bin"
    folder.mkdir()
    for name, body in {"pdfinfo": "printf 'Title: T\\nPages: 2\\nPage size: 612 x 792 pts\\n'", "pdfimages": "printf 'page num\\n----\\n2 0 image\\n'", "pdftotext": f"if [ \"$1\" = -layout ]; then printf 'Supply chain\\fx\\f'; else cat <<'X'\n{LAYOUT}\nX\nfi"}.items():
        (folder / name).write_text(f"#!/bin/sh\n{body}\n")
        (folder / name).chmod(stat.S_IRWXU)
    monkeypatch.setenv("PATH", f"{folder}:{os.environ['PATH']}")
    source = tmp_path / "a.pdf"
    source.write_bytes(b"%PDF-1.4\nhello\n")
    return str(source)


def test_lifecycle(spark, tools, tmp_path, monkeypatch):
    monkeypatch.setattr("leafseek.sources.pdf.tool_available", lambda name: True)
    output = str(tmp_path / "out")
    # workers keep the environment they began with, so the tools run on the driver here
    from leafseek.sources import pdf

    outputs = pdf.tool_outputs(tools) | {"document_id": "sha256:x", "path": tools}
    df = spark.createDataFrame([outputs], "document_id string, path string, info string, text string, layout string, images string, warnings array<string>")
    monkeypatch.setattr("leafseek.sources.pdf.read_outputs", lambda *a, **k: df)
    plan = api.ExtractionPlan(output, reuse=True)
    assert api.extract_pdf(spark, tools, plan) == output
    assert sorted(os.listdir(output)) == ["assets", "build-report.json", "inspect.json", "manifest.json", "pages.jsonl", "spans.jsonl", "text"]
    first, second = [json.loads(x) for x in open(f"{output}/pages.jsonl")]
    assert (first["text"], first["extraction_status"], second["extraction_status"], second["image_count"]) == ("supply ch&inresilience", "ok", "fallback", 1)
    assert len(open(f"{output}/spans.jsonl").readlines()) == 3
    assert api.cache_status(output, tools)["fresh"] and api.extract_pdf(spark, tools, plan) == output
    with pytest.raises(LeafseekError) as refused:
        api.extract_pdf(spark, tools, api.ExtractionPlan(output))
    assert refused.value.code == 3 and not os.path.exists(artifacts.cache_lock_path(output))
    manifest = json.load(open(f"{output}/manifest.json"))
    for name in ("pages", "spans"):  # the stand-in's document id
        text = open(f"{output}/{name}.jsonl").read().replace("sha256:x", manifest["document_id"])
        open(f"{output}/{name}.jsonl", "w").write(text)
    with pytest.raises(LeafseekError) as missing:
        api.open_index(spark, output)
    assert missing.value.code == 5
    database = api.index_directory(spark, output)
    assert api.index_directory(spark, output) == database and api.status(spark, output)["fresh"]
    handle = api.open_index(spark, database)
    assert handle.table("assets").count() == 0
    hit = api.search(handle, "resilience", boxes=True).collect()
    assert [(h.document, h.page, h.start, h.stop, len(h.boxes)) for h in hit] == [("a.pdf", 1, 13, 23, 1)]
    assert api.benchmark_search(handle, ["supply"])[0]["matches"] == 1
    with open(tools, "ab") as f:
        f.write(b"more")
    assert api.status(spark, output)["reason"] == "the file is not the one that was indexed"
    with pytest.raises(LeafseekError):
        api.index_directory(spark, output)
    assert api.unpack_pdf(tools, str(tmp_path / "assets"), ["images", "Fonts"]) and "fonts_unavailable" in open(tmp_path / "assets" / "unpack-manifest.json").read()


def test_fallback_pages(spark):
    from leafseek.sources import pdf

    df = spark.createDataFrame([("d", "Pages: 2\n", "One  TWO\fx", None, None, ["geometry_unavailable"])], "document_id string, info string, text string, layout string, images string, warnings array<string>")
    pages, spans = pdf.extract_pages(df)
    assert [(p.text, p.extraction_status, p.warnings) for p in pages.orderBy("page_number").collect()] == [("one two", "fallback", ["geometry_unavailable"]), ("x", "fallback", ["geometry_unavailable"])]
    assert [(s.start, s.stop, s.original_start, s.original_stop, s.bbox) for s in spans.orderBy("page_number").collect()] == [(1, 8, 1, 9, None), (1, 2, 1, 2, None)]


def test_layout_tables(spark):
    df = spark.createDataFrame([("d", LAYOUT)], "document_id string, output string")
    rows = layout.layout_words(df).orderBy("word_no").collect()
    assert [(r.word, r.line, r.bbox is None) for r in rows] == [("Supply", 1, False), ("ch&in-", 1, True), ("resilience", 2, False)]
    info = layout.metadata(spark.createDataFrame([("d", "A: b:c\nnone\nPages: 3")], "document_id string, output string")).first().info
    assert info == {"A": "b:c", "Pages": "3"}


def test_locks(tmp_path):
    lock = api.acquire_cache_lock(str(tmp_path / "x"))
    with pytest.raises(LeafseekError) as conflict:
        api.acquire_cache_lock(str(tmp_path / "x"))
    assert conflict.value.code == 3
    api.release_cache_lock(lock)
    api.release_cache_lock(lock)


def test_cache_reasons(tmp_path):
    source = tmp_path / "a.pdf"
    source.write_bytes(b"%PDF-1.4\nhello\n")
    assert api.cache_status(str(tmp_path), str(source))["reason"] == artifacts.REASONS["unbuilt"]
    (tmp_path / "manifest.json").write_text('{"cache_key":"x","state":"extracted"}')
    assert api.cache_status(str(tmp_path), str(source))["reason"] == artifacts.REASONS["partial"]
    key = api.artifact_cache_key(str(source))
    assert key == api.artifact_cache_key(str(source)) != api.artifact_cache_key(str(source), strict=True)
    (tmp_path / "b.pdf").write_text("just text")
    with pytest.raises(LeafseekError) as bad:
        api.artifact_cache_key(str(tmp_path / "b.pdf"))
    assert bad.value.code == 3


def test_tools():
    quick = ToolRunner(timeout=0.2)
    assert run_tool(quick, "sh", ["-c", "cat; echo err >&2; exit 3"], stdin="in").exit_code == 3
    assert run_tool(quick, "sleep", ["5"]).timed_out
    assert run_tool(quick, "no-such-tool", []).exit_code == -1
    stop = threading.Event()
    stop.set()
    assert run_tool(ToolRunner(), "sleep", ["5"], cancel=stop).cancelled
    assert run_tool(quick, "true", []).success
    with pytest.raises(ValueError):
        ToolRunner(timeout=0)


def test_json():
    assert json_string({"b": 1, "a": float("inf"), "c": (1, 2)}) == '{"a":null,"b":1,"c":[1,2]}'
    for bad in ("{} x", "{", "NaN", "[1,]"):
        with pytest.raises(ValueError):
            parse_json(bad)


def test_command_line(capsys, tmp_path):
    assert cli.main([]) == 2 and cli.main(["--help"]) == 0 and cli.main(["--version"]) == 0
    assert cli.main(["nothing"]) == 2 and cli.main(["search", "x", "y", "--page", "0"]) == 2 and cli.main(["extract", "x"]) == 2
    assert cli.main(["inspect", str(tmp_path / "none.pdf")]) == 3
    assert cli.parse_options(["a", "--pages", "--out=x", "--limit", "3", "--", "--b"]) == (["a", "--b"], {"pages": True, "out": "x", "limit": "3"})
    assert cli.page_range({"pages": "2:4"}) == (2, 4) and cli.page_range({"pages": "3"}) == (3, 3)
    assert cli.parse_options(["a b", "--pages", "2:3", "--limit=", "-x", "c"]) == (["a b", "-x", "c"], {"pages": "2:3", "limit": ""})
    with pytest.raises(LeafseekError):
        cli.parse_options(["--limit"])
    for bad in ("4:2", "x", "1:2:3"):
        with pytest.raises(LeafseekError):
            cli.page_range({"pages": bad})
    with pytest.raises(LeafseekError):
        cli.parse_options(["--unknown"])


def test_surface():
    assert api.error_code_name(5) == "IndexError" and api.error_code_name(77) == "UnknownError"
    error = LeafseekError(3, "extract", "x", "m", "r")
    assert str(error) == 'extract failed for "x": m. r' and api.error_dict(error)["exit_code"] == 3
    assert set(api.capabilities()["tools"]) == {"pdfinfo", "pdftotext", "pdfimages"} and not api.provider_capabilities()["ocr"]["available"]
    assert all(hasattr(api, name) for name in api.__all__)
