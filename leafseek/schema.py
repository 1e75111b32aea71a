"""Records and table schemas. Offsets are 1-based characters; ``stop`` is exclusive."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

# Versions that artifacts carry.
ARTIFACT_SCHEMA_VERSION, INDEX_SCHEMA_VERSION = 2, 2
PARSER_NAME, PARSER_VERSION, NORMALIZATION_VERSION = "poppler", "0.1", "1"

BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"
PAGES = "document_id string, page_number int, width double, height double, rotation int, text string, original_text string, text_hash string, image_count int, annotation_count int, extraction_status string, warnings array<string>"
SPANS = f"document_id string, page_number int, span_id int, start int, stop int, original_start int, original_stop int, text string, original_text string, bbox {BBOX}"
NORM_MAP = "array<struct<first:int,last:int>>"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


@dataclass(frozen=True)
class BBox:
    x0: float
    y0: float
    x1: float
    y1: float


@dataclass(frozen=True)
class Span:
    span_id: int
    page_number: int
    start: int
    stop: int
    original_start: int
    original_stop: int
    text: str
    original_text: str
    bbox: BBox | None = None

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class PageRecord:
    document_id: str
    page_number: int
    width: float
    height: float
    rotation: int
    text: str
    original_text: str
    text_hash: str
    spans: tuple[Span, ...] = ()
    image_count: int = 0
    annotation_count: int = 0
    extraction_status: str = "ok"
    warnings: tuple[str, ...] = ()

    def to_dict(self, include_spans: bool = True) -> dict:
        out = asdict(self)
        out["warnings"], spans = list(self.warnings), [s.to_dict() for s in self.spans]
        del out["spans"]
        return out | ({"spans": spans} if include_spans else {})


@dataclass(frozen=True)
class ExtractionPlan:
    """What to extract and where to; ``pages`` is a contiguous range (first, last)."""

    output: str
    include_boxes: bool = True
    pages: tuple[int, int] | None = None
    strict: bool = False
    force: bool = False
    include_text_files: bool = True
    reuse: bool = False

    def __post_init__(self):
        if self.pages is not None:
            pages = list(self.pages)
            object.__setattr__(self, "pages", (int(pages[0]), int(pages[-1])))


@dataclass(frozen=True)
class OCRPage:
    page_number: int
    text: str
    confidence: float | None = None
    source: str = ""


@dataclass(frozen=True)
class OCRResult:
    provider: str
    version: str
    pages: tuple[OCRPage, ...] = ()
    warnings: tuple[str, ...] = field(default=())
