"""Settings of the engine, from the environment where set."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def _env(name: str, default, kind=str):
    value = os.environ.get(f"QUARRYSTONE_{name}")
    return default if value is None else kind(value)


@dataclass(frozen=True)
class Settings:
    """Limits, sizes and model parameters."""

    data_file: str = field(default_factory=lambda: _env("DATA_FILE", ""))
    blocks_path: str = field(default_factory=lambda: _env("BLOCKS_PATH", ""))
    store_path: str = field(default_factory=lambda: _env("STORE_PATH", ""))
    web_corpus_path: str = field(default_factory=lambda: _env("WEB_CORPUS_PATH", ""))
    pdf_corpus_path: str = field(default_factory=lambda: _env("PDF_CORPUS_PATH", ""))
    max_url_pages: int = field(default_factory=lambda: _env("MAX_URL_PAGES", 20, int))
    url_timeout: float = field(default_factory=lambda: _env("URL_TIMEOUT", 20.0, float))
    max_url_page_bytes: int = field(default_factory=lambda: _env("MAX_URL_PAGE_BYTES", 5_000_000, int))
    max_pdf_files: int = field(default_factory=lambda: _env("MAX_PDF_FILES", 10, int))
    max_pdf_file_bytes: int = field(default_factory=lambda: _env("MAX_PDF_FILE_BYTES", 50_000_000, int))
    embedding_model: str = field(default_factory=lambda: _env("EMBEDDING_MODEL", "hashing"))
    extraction_model: str = field(default_factory=lambda: _env("EXTRACTION_MODEL", "rules"))
    answer_model: str = field(default_factory=lambda: _env("ANSWER_MODEL", "extractive"))
    embedding_dimensions: int = field(default_factory=lambda: _env("EMBEDDING_DIMENSIONS", 768, int))
    embed_batch_size: int = field(default_factory=lambda: _env("EMBED_BATCH_SIZE", 64, int))
    embed_batch_delay: float = field(default_factory=lambda: _env("EMBED_BATCH_DELAY", 1.4, float))
    chunk_words: int = field(default_factory=lambda: _env("CHUNK_WORDS", 450, int))
    chunk_overlap: int = field(default_factory=lambda: _env("CHUNK_OVERLAP", 60, int))
    extraction_batch_size: int = field(default_factory=lambda: _env("EXTRACTION_BATCH_SIZE", 5, int))
    api_key: str = field(default_factory=lambda: _env("API_KEY", ""), repr=False)

    def require_key(self) -> str:
        if not self.api_key.strip():
            raise ValueError("an API key is needed for remote models")
        return self.api_key
