"""Seams for text recognition and enrichment; none is configured here."""

from __future__ import annotations

from typing import Protocol

from .schema import OCRResult


class OCRProvider(Protocol):
    """Recognizes text of pages; its result is a table of its own and never replaces native text."""

    name: str
    version: str

    def ocr(self, source: str, pages: tuple[int, int] | None = None, **options) -> OCRResult: ...


class EnrichmentProvider(Protocol):
    name: str
    version: str


class UnconfiguredOCRProvider:
    name, version = "none", "0"

    def ocr(self, source: str, pages=None, **options) -> OCRResult:
        raise ValueError(f"no OCR provider is configured for {source}")


NO_OCR_PROVIDER = UnconfiguredOCRProvider()


def provider_capabilities() -> dict:
    return {"ocr": {"available": False, "provider": NO_OCR_PROVIDER.name, "version": NO_OCR_PROVIDER.version}, "enrichment": {"available": False, "providers": []}}
