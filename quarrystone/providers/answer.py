"""Answers from a context."""

from __future__ import annotations

import re
from abc import ABC, abstractmethod

FALLBACK = "No answer could be generated from the retrieved context."


class Generator(ABC):
    @abstractmethod
    def answer(self, question: str, context: str, temperature: float = 0.2) -> str: ...


class ExtractiveGenerator(Generator):
    """Offline: the labels of the context's entries, and the sentence that shares most words with the question."""

    def answer(self, question: str, context: str, temperature: float = 0.2) -> str:
        if not context.strip():
            return FALLBACK
        asked = set(re.findall(r"\w+", question.lower()))
        sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n", context) if s.strip() and not s.startswith("[chunk")]
        best = max(sentences, key=lambda s: (len(asked & set(re.findall(r"\w+", s.lower()))), -len(s)), default="")
        labels = re.findall(r"^\[(chunk [^\]]+)\]", context, re.M)
        return f"{best} ({'; '.join(labels)})" if best else FALLBACK
