"""Encoding and decoding with sentencepiece vocabularies of the merge type.

Texts are encoded by the score-ordered agenda of adjacent symbol pairs (see
``pieces``), and decoded by the library. Every segment that is encoded for the
first time in a worker's memory is checked in its Arrow batch against the
sentencepiece library; as no merge crosses a segment border, equal segments
make equal texts. A difference stops the job.

Defined cases: a null or empty text has the end id only and decodes to an
empty text; characters in no piece are spelt in byte pieces; strings that look
like special tokens are ordinary text; texts of any length are taken whole;
repeated rows give repeated results; an empty table gives an empty result;
``encode`` keeps extra columns out of its result.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, slices, utf8, worker_state
from .pieces import SPACE, Recent, Vocabulary

KEPT = 80_000


class Codec:
    def __init__(self, vocab: Vocabulary, kept: int = KEPT):
        self.vocab, self.recent = vocab, Recent(kept)
        # a character of no piece ends the segment before it, so what the library makes of it is a fixed head
        self.border = next(c for c in "\n\x01\x02\x03￿" if c not in vocab.symbol)
        self.head = vocab.lib.encode(self.border)

    def _made(self, segments: list[str]) -> list[tuple[str, bytes]]:
        """The spelling of each segment's ids and the ids in 32 bits each, checked against the library."""
        ids = self.vocab.encode(segments)
        n = len(self.head)
        theirs = self.vocab.lib.encode([self.border + x.replace(SPACE, " ") for x in segments], num_threads=1)
        for own, other, x in zip(ids, theirs, segments):
            if own != other[n:]:
                raise ValueError(f"segment {x!r}: {own} here, {other[n:]} by the library")
        return [(" ".join(map(str, x)), array("i", x).tobytes()) for x in ids]

    def encoded(self, texts: list[str], eos: bool = True) -> tuple[list[list[int]], list[str]]:
        """Ids of each text, and the ids spelt in decimal, joined by one space."""
        segments = [self.vocab.segments(x) for x in texts]
        known = self.recent.fetch(itertools.chain.from_iterable(segments), self._made)
        end = array("i", [self.vocab.eos] if eos else []).tobytes()
        tail = [str(self.vocab.eos)] if eos else []
        ids, spelt = [], []
        for own in segments:
            found = [known[x] for x in own]
            spelt.append(" ".join([x[0] for x in found] + tail))
            ids.append(np.frombuffer(b"".join([x[1] for x in found]) + end, np.int32).tolist())
        return ids, spelt


def _codec(path: str) -> Codec:
    return worker_state(("codec", path), lambda: Codec(Vocabulary(path)))


def _run(documents: DataFrame, path: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    ready(documents.sparkSession)
    hexed = lambda x: hashlib.sha256(x.encode("utf-8")).hexdigest()

    def run(batches):
        codec = _codec(path)
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, 1 << 20):
                gc.disable()  # the many small lists made here hold no cycles
                texts = [x or "" for x in batch.column(1).slice(a, b - a).to_pylist()]
                ids, spelt = codec.encoded(texts)
                back = codec.vocab.lib.decode(ids)
                n = pa.array([len(x) for x in ids], pa.int64())
                if digest:
                    columns = [n, pa.array([hexed(x) for x in spelt]), pa.array([hexed(x) for x in back])]
                    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32)
                    ends = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
                    columns = [n, pa.ListArray.from_arrays(ends, pa.array(flat)), pa.array(back, pa.string())]
                    names = ["id", "n_tokens", "ids", "decoded"]
                gc.enable()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=names)

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rest = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, {rest}").withColumnRenamed("id", id_col)


def encode(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (with the end id), decoded text of every row."""
    return _run(documents, path, id_col, text_col, False)


def encode_digests(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and SHA-256 of the spelt ids and of the decoded text; ids and text stay in their batch."""
    return _run(documents, path, id_col, text_col, True)
