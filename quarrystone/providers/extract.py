"""Extraction of entities and relations from chunks, and the reading of model answers."""

from __future__ import annotations

import json
import re
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.schemas import EXTRACTION

MOST_ENTITIES, MOST_RELATIONS = 20, 30

_ENTITY = pa.list_(pa.struct([("name", pa.string()), ("description", pa.string())]))
_RELATION = pa.list_(pa.struct([(x, pa.string()) for x in ("source", "target", "relation", "description")]))


class GraphExtractionError(RuntimeError):
    """A model's answer lacks chunks that were asked for, or can't be read."""


class Extractor(ABC):
    @abstractmethod
    def extract(self, chunks: DataFrame) -> DataFrame:
        """``schemas.EXTRACTION`` rows for chunks (id, text or source_text)."""


def capped(extractions: DataFrame) -> DataFrame:
    """At most 20 entities and 30 relations a chunk."""
    return extractions.select(
        "chunk_id", F.slice("entities", 1, MOST_ENTITIES).alias("entities"), F.slice("relations", 1, MOST_RELATIONS).alias("relations")
    )


class RuleExtractor(Extractor):
    """Offline: runs of capitalised words are entities, two of them in one sentence a relation."""

    _RUN = re.compile(r"[^\W\d_a-zà-ÿ][\w’'-]*(?:\s+[^\W\d_a-zà-ÿ][\w’'-]*)+")
    _SENTENCE = re.compile(r"(?<=[.!?])\s+")

    def rules(self, text: str | None) -> tuple[list[dict], list[dict]]:
        entities: dict[str, str] = {}
        relations = []
        for sentence in self._SENTENCE.split(text or ""):
            found = [" ".join(m.split()) for m in self._RUN.findall(sentence)]
            for name in found:
                entities.setdefault(name, sentence.strip())
            relations += [{"source": a, "target": b, "relation": "mentioned with", "description": sentence.strip()} for a, b in zip(found, found[1:]) if a != b]
        return [{"name": n, "description": d} for n, d in list(entities.items())[:MOST_ENTITIES]], relations[:MOST_RELATIONS]

    def extract(self, chunks: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                read = [self.rules(t) for t in b.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("chunk_id"), pa.array([r[0] for r in read], _ENTITY), pa.array([r[1] for r in read], _RELATION)],
                    names=["chunk_id", "entities", "relations"],
                )

        said = F.coalesce("source_text", "text") if "source_text" in chunks.columns else F.col("text")
        return chunks.select(F.col("id").alias("chunk_id"), said.alias("_text")).mapInArrow(run, EXTRACTION)


def decode_objects(answer: str) -> list[dict]:
    """All JSON objects of a text that may hold several, one after the other, or a list of them, in a code fence or not."""
    body = re.sub(r"\s*```$", "", re.sub(r"^```\w*\s*", "", answer.strip()))
    found, at, read = [], 0, json.JSONDecoder()
    while True:
        opened = re.compile(r"[\[{]").search(body, at)
        if opened is None:
            return [x for x in found if isinstance(x, dict)]
        try:
            value, at = read.raw_decode(body, opened.start())
        except ValueError:
            at = opened.start() + 1
            continue
        found += value if isinstance(value, list) else [value]


def records_of(answer: str) -> dict[int, dict]:
    """The last record of each chunk id in an answer; what isn't an object with a whole-number id is passed over."""
    out = {}
    for x in decode_objects(answer):
        for record in x.get("chunks", [x]) if isinstance(x.get("chunks"), list) else [x]:
            key = record.get("chunk_id") if isinstance(record, dict) else None
            if isinstance(key, int) and not isinstance(key, bool):
                out[key] = record
    return out


def parse_extractions(answers: DataFrame, expected: DataFrame, answer: str = "answer") -> DataFrame:
    """Extraction rows from raw model answers (``answer``); ``expected`` (chunk_id) are the chunks asked for.

    Of several records of one chunk the last counts; records of other chunks are dropped. A chunk without a record
    raises GraphExtractionError.
    """

    def text_of(x: dict, *names: str) -> dict:
        return {n: x.get(n) if isinstance(x.get(n), str) else "" for n in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for seq, a in zip(b.column("_seq").to_pylist(), b.column("_answer").to_pylist()):
                for i, (key, r) in enumerate(records_of(a or "").items()):
                    es = [text_of(e, "name", "description") for e in r.get("entities") or [] if isinstance(e, dict)]
                    rs = [text_of(e, "source", "target", "relation", "description") for e in r.get("relations") or [] if isinstance(e, dict)]
                    rows.append((key, es, rs, seq * 100_000 + i))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], _ENTITY), pa.array([r[2] for r in rows], _RELATION), pa.array([r[3] for r in rows], pa.int64())],
                names=["chunk_id", "entities", "relations", "_order"],
            )

    seq = F.col("answer_no") if "answer_no" in answers.columns else F.lit(0)
    read = answers.select(seq.cast("long").alias("_seq"), F.col(answer).alias("_answer")).mapInArrow(
        run, "chunk_id long, entities array<struct<name:string,description:string>>, relations array<struct<source:string,target:string,relation:string,description:string>>, _order long"
    )
    last = read.groupBy("chunk_id").agg(F.max_by(F.struct("entities", "relations"), "_order").alias("r")).select("chunk_id", "r.*")
    wanted = expected.select("chunk_id").distinct()
    lost = wanted.join(last, "chunk_id", "left_anti").orderBy("chunk_id").limit(10).collect()
    if lost:
        raise GraphExtractionError(f"no record for chunks {[r.chunk_id for r in lost]}")
    return capped(last.join(wanted, "chunk_id", "left_semi"))


def batch_answers(ids: Iterable[int], size: int = 5) -> list[list[int]]:
    """Chunk ids in the batches a model is asked about."""
    ids = list(ids)
    return [ids[i : i + size] for i in range(0, len(ids), size)]
