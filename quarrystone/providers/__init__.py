"""Models behind interfaces: embedding, extraction and answers. The offline ones are deterministic."""

from quarrystone.providers.answer import ExtractiveGenerator, Generator
from quarrystone.providers.embed import Embedder, HashingEmbedder, PrecomputedEmbedder, RemoteEmbedder
from quarrystone.providers.extract import Extractor, GraphExtractionError, RuleExtractor, parse_extractions

__all__ = [
    "Embedder", "ExtractiveGenerator", "Extractor", "Generator", "GraphExtractionError", "HashingEmbedder", "PrecomputedEmbedder",
    "RemoteEmbedder", "RuleExtractor", "parse_extractions",
]
