"""PDF sources: validation, tools on the executors, and extraction into pages and spans.

Many documents are read with ``binaryFile`` and pass through one Arrow map that
runs the tools on a local copy; everything after the tools' output is DataFrame
work. One document uses the same functions on the driver.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import INPUT, INTERNAL, PARSE, LeafseekError
from ..functions.normalize import indexed, normalize_text, normalized
from ..functions.text import page_size, parse_int
from ..operators.spans import build_spans, page_texts
from ..session import ship
from ..tools import ToolRunner, run_tool, tool_available
from . import layout

RUNNER = ToolRunner(timeout=60.0)
# Names of the tools and of the metadata that reports keep.
INFO, TEXT, IMAGES = "pdfinfo", "pdftotext", "pdfimages"
METADATA = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")
_OUTPUTS = "document_id string, path string, size_bytes long, signature boolean, info string, text string, layout string, images string, warnings array<string>"


def ensure_pdf_path(path: str, action: str) -> str:
    path = os.path.abspath(str(path))
    if not os.path.isfile(path):
        raise LeafseekError(INPUT, action, path, "there is no such file", "name an existing PDF")
    try:
        with open(path, "rb") as f:
            head = f.read(5)
    except OSError as error:
        raise LeafseekError(INPUT, action, path, "the file cannot be opened", "grant this user to read it") from error
    if head != b"%PDF-":
        raise LeafseekError(INPUT, action, path, "the file lacks the PDF signature", "name a PDF")
    return path


def sha256_file(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def run_pdf_command(executable: str, args: list[str], action: str, source: str, runner: ToolRunner = RUNNER) -> str:
    result = run_tool(runner, executable, args)
    if result.success:
        return result.stdout
    if result.exit_code == -1 and not (result.timed_out or result.cancelled):
        raise LeafseekError(INTERNAL, action, source, f"{executable} is not installed", "put the PDF tools on the path")
    reason = "timed out" if result.timed_out else "was cancelled" if result.cancelled else result.stderr.strip() or f"exit code {result.exit_code}"
    raise LeafseekError(PARSE, action, source, f"{executable}: {reason}", "try another copy of the file")


def tool_outputs(path: str, strict: bool = False) -> dict:
    """What the tools print for one local file; geometry and images may be missing with a warning."""
    out: dict = {"info": run_pdf_command(INFO, [path], "extract", path), "text": None, "layout": None, "images": None, "warnings": []}
    if not tool_available(IMAGES):
        out["warnings"].append(f"image_count_unavailable: {IMAGES} is not installed")
    else:
        listed = run_tool(RUNNER, IMAGES, ["-list", path])
        if listed.success:
            out["images"] = listed.stdout
        else:
            out["warnings"].append(f"image_count_unavailable: {IMAGES} " + ("timed out" if listed.timed_out else "was cancelled" if listed.cancelled else "could not inspect the file"))
    try:
        out["layout"] = run_pdf_command(TEXT, ["-bbox-layout", path, "-"], "extract", path)
    except LeafseekError:
        if strict:
            raise
        out["warnings"].append("geometry_unavailable: pages come from plain text, without boxes")
        out["text"] = run_pdf_command(TEXT, ["-layout", path, "-"], "extract", path)
    return out


def read_outputs(spark: SparkSession, paths: str, strict: bool = False) -> DataFrame:
    """Tool outputs of all files under ``paths``; files without the signature are kept and marked."""
    ship(spark)
    files = spark.read.format("binaryFile").load(paths).select(F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("document_id"), "path", F.col("length").alias("size_bytes"), (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("signature"), "content")

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                content, out = row.pop("content"), {"info": None, "text": None, "layout": None, "images": None, "warnings": []}
                if row["signature"]:
                    with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
                        f.write(content)
                        f.flush()
                        try:
                            out = tool_outputs(f.name, strict)
                        except LeafseekError as error:
                            if strict:
                                raise
                            out["warnings"].append(f"extraction_failed: {error.message}")
                rows.append(row | out)
            string = pa.string()
            kinds = [("document_id", string), ("path", string), ("size_bytes", pa.int64()), ("signature", pa.bool_()), ("info", string), ("text", string), ("layout", string), ("images", string), ("warnings", pa.list_(string))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return files.mapInArrow(run, _OUTPUTS)


def extract_pages(outputs: DataFrame, pages: tuple[int, int] | None = None, include_boxes: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pages and spans from tool outputs (document_id, info, text, layout, images, warnings).

    A page without words from the layout falls back to its text, as one span
    without a box.
    """
    info = layout.metadata(outputs.select("document_id", F.coalesce("info", F.lit("")).alias("output")))
    info = info.select("document_id", parse_int(F.element_at("info", "Pages")).alias("page_count"), page_size(F.coalesce(F.element_at("info", "Page size"), F.lit(""))).alias("size"))
    known = outputs.join(info, "document_id").where("page_count > 0")
    numbers = known.select("document_id", "size", "warnings", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page_number"))
    if pages is not None:
        numbers = numbers.where(F.col("page_number").between(*pages))
    words = layout.layout_words(known.select("document_id", F.coalesce("layout", F.lit("")).alias("output")))
    spans = build_spans(words, include_boxes)
    made = page_texts(spans)
    sizes = words.groupBy("document_id", "page_number").agg(F.first("width").alias("width"), F.first("height").alias("height"))
    plain = layout.split_pages(known.select("document_id", F.coalesce("text", F.lit("")).alias("output"), "page_count")).withColumnRenamed("original_text", "plain")
    images = layout.image_counts(known.select("document_id", F.coalesce("images", F.lit("")).alias("output"), "page_count"))
    key = ["document_id", "page_number"]
    all_pages = numbers.join(made, key, "left").join(sizes, key, "left").join(plain, key, "left").join(images, key, "left").withColumn("_plain", normalized(F.coalesce("plain", F.lit(""))))
    has_words = F.col("text").isNotNull()
    text = F.coalesce("text", "_plain")
    out = all_pages.select(
        *key,
        F.coalesce("width", "size.width").alias("width"),
        F.coalesce("height", "size.height").alias("height"),
        F.lit(0).alias("rotation"),
        text.alias("text"),
        F.coalesce("original_text", "plain", F.lit("")).alias("original_text"),
        F.sha2(text, 256).alias("text_hash"),
        F.coalesce("image_count", F.lit(0)).alias("image_count"),
        F.lit(0).alias("annotation_count"),
        F.when(has_words, F.lit("ok")).otherwise(F.lit("fallback")).alias("extraction_status"),
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
    )
    whole = out.where("extraction_status = 'fallback' and text <> ''").withColumn("_i", indexed("original_text"))
    last = F.get("_i.norm_map", F.size("_i.norm_map") - 1)["last"]
    fallback = whole.select(*key, F.lit(1).alias("span_id"), F.lit(1).alias("start"), (F.length("text") + 1).alias("stop"), F.get("_i.norm_map", 0)["first"].alias("original_start"), (last + 1).alias("original_stop"), "text", "original_text", F.lit(None).cast(spans.schema["bbox"].dataType).alias("bbox"))
    chosen = spans if pages is None else spans.where(F.col("page_number").between(*pages))
    return out, chosen.unionByName(fallback)


def inspect(outputs: dict, source: str, include_pages: bool = False, include_objects: bool = False) -> dict:
    """The report on one document, from its tool outputs."""
    info = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in (outputs["info"] or "").split("\n")) if _}
    try:
        n = int(info.get("Pages", "0"))
    except ValueError:
        n = 0
    chunks = (outputs.get("text") or "").split("\f")
    chunks = (chunks + [""] * n)[:n]
    present = [bool(normalize_text(c)) for c in chunks]
    counts, begun = [0] * n, False
    for line in (outputs.get("images") or "").split("\n"):
        fields = line.split()
        if line.strip().startswith("page"):
            begun = True
        elif begun and fields and fields[0].isdigit() and 1 <= int(fields[0]) <= n:
            counts[int(fields[0]) - 1] += 1
    yes = lambda k: info.get(k, "no").strip().lower() in ("yes", "true", "1")
    report = {
        "schema_version": 2,
        "source": {"path": source, "sha256": sha256_file(source), "size_bytes": os.path.getsize(source)},
        "pdf": {"version": info.get("PDF version", "unknown"), "pages": n, "encrypted": yes("Encrypted"), "linearized": yes("Linearized")},
        "metadata": {k: info[k] for k in METADATA if k in info},
        "health": {"text_native_pages": sum(present), "image_only_pages": n - sum(present)},
        "warnings": list(outputs.get("warnings") or []),
    }
    if include_pages:
        report["pages"] = [{"page_number": i + 1, "rotation": 0, "text_present": p, "image_count": c, "annotation_count": 0, "extraction_status": "text_present" if p else "empty_or_image_only"} for i, (p, c) in enumerate(zip(present, counts, strict=True))]
    if include_objects:
        missing = "not_read_by_these_tools"
        report["objects"] = {"images": sum(counts), "fonts": missing, "annotations": missing, "attachments": missing}
    return report
