"""The public surface in one place."""

from __future__ import annotations

import shutil
import time

from . import __version__
from .errors import LeafseekError, error_code_name, error_dict
from .plans.artifacts import acquire_cache_lock, artifact_cache_key, cache_lock_path, cache_status, extract_pdf, release_cache_lock, unpack_pdf
from .plans.index import IndexBackend, IndexHandle, ParquetBackend, index_directory, index_status, open_index, search
from .providers import EnrichmentProvider, OCRProvider, provider_capabilities
from .schema import ARTIFACT_SCHEMA_VERSION, INDEX_SCHEMA_VERSION, PARSER_NAME, PARSER_VERSION, BBox, ExtractionPlan, OCRPage, OCRResult, PageRecord, Span
from .sources import pdf
from .sources.jsonio import json_string
from .tools import ToolResult, ToolRunner, run_tool, tool_available, tool_path

API_VERSION = "1.0.0"
TOOLS = {pdf.INFO: "PDF metadata reader", pdf.TEXT: "PDF text reader", pdf.IMAGES: "PDF image inspector"}
serialize_result = json_string
status = index_status


def package_version() -> str:
    return __version__


def capabilities() -> dict:
    tools = {name: {"available": tool_available(name), "path": tool_path(name) or ""} for name in TOOLS}
    return {"name": "leafseek", "version": __version__, "api_version": API_VERSION, "artifact_schema_version": ARTIFACT_SCHEMA_VERSION, "index_schema_version": INDEX_SCHEMA_VERSION, "parser": {"name": PARSER_NAME, "version": PARSER_VERSION}, "index_backend": "parquet", "tools": tools, "providers": provider_capabilities()}


def inspect_pdf(path: str, include_pages: bool = False, include_objects: bool = False, strict: bool = False) -> dict:
    source = pdf.ensure_pdf_path(path, "inspect")
    outputs = pdf.tool_outputs(source, strict)
    if outputs["text"] is None:
        try:
            outputs["text"] = pdf.run_pdf_command(pdf.TEXT, ["-layout", source, "-"], "inspect", source)
        except LeafseekError as error:
            if strict:
                raise
            outputs["warnings"].append(f"text_health_unavailable: {error}")
    return pdf.inspect(outputs, source, include_pages, include_objects)


def doctor_report(spark=None, fixtures: str | None = None) -> dict:
    """Whether tools and Spark are there; with a session also whether it can answer a query."""
    import os

    checks = [{"name": "java", "description": "Java runtime", "ok": shutil.which("java") is not None, "path": shutil.which("java") or ""}]
    checks += [{"name": n, "description": d, "ok": tool_available(n), "path": tool_path(n) or ""} for n, d in TOOLS.items()]
    if spark is not None:
        from .operators.search import index_pages, search_pages
        from .session import ship

        ship(spark)
        page = spark.createDataFrame([("probe", 1, "phrase search")], "document_id string, page_number int, original_text string")
        checks.append({"name": "spark-search", "description": "phrase search on Spark", "ok": search_pages(index_pages(page), '"phrase search"').count() == 1})
    if fixtures is not None:
        checks.append({"name": "fixtures", "description": "fixture directory", "ok": os.path.isdir(fixtures), "path": os.path.abspath(fixtures)})
    return {"schema_version": ARTIFACT_SCHEMA_VERSION, "ok": all(c["ok"] for c in checks), "checks": checks}


def benchmark_search(handle: IndexHandle, queries: list[str], limit: int = 20) -> list[dict]:
    """Milliseconds of each query on an opened index."""
    out = []
    for query in queries:
        started = time.perf_counter()
        n = len(search(handle, query, limit=limit).collect())
        out.append({"query": query, "matches": n, "elapsed_ms": (time.perf_counter() - started) * 1000})
    return out


__all__ = [
    "BBox", "EnrichmentProvider", "ExtractionPlan", "IndexBackend", "IndexHandle", "LeafseekError", "OCRPage", "OCRProvider", "OCRResult", "PageRecord", "ParquetBackend", "Span", "ToolResult", "ToolRunner",
    "acquire_cache_lock", "artifact_cache_key", "benchmark_search", "cache_lock_path", "cache_status", "capabilities", "doctor_report", "error_code_name", "error_dict", "extract_pdf", "index_directory", "inspect_pdf",
    "open_index", "package_version", "provider_capabilities", "release_cache_lock", "run_tool", "search", "serialize_result", "status", "unpack_pdf",
]
