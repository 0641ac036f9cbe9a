"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from stratalog.sources.tables import spread

DEFAULT_FOLDER, DEFAULT_VOCABULARY = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), "byte_bpe_50k.tiktoken"
#: Fixed value: how the rank files of the public tokenizers expect a text to be split before merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters from which a text is encoded in stretches, and where the pattern always splits: before one blank in between.
_PIECE, _BETWEEN = 400_000, re.compile(r"(?<=\S)(?= \S)")


def vocabulary_path(folder: str | None = None, name: str = DEFAULT_VOCABULARY) -> str:
    return str(Path(folder or DEFAULT_FOLDER) / name)


def encoder(path: str):
    """The byte-level BPE whose ranks the file at ``path`` lists; special tokens are ordinary text."""
    import tiktoken

    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(coder, text: str) -> int:
    """Tokens of a whole text; a very long one is encoded in stretches, cut only where no token can reach across."""
    total, at = 0, 0
    while at < len(text):
        cut = _BETWEEN.search(text, at + _PIECE)
        end = cut.start() if cut else len(text)
        total += len(coder.encode_ordinary(text[at:end]))
        at = end
    return total


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``keep``, n_tokens (0 for a null or empty text), part and place: the task that counted the row and its rank among the rows of
    that task with as many tokens. The rank makes a global one cheap: see ``packing``. Stage the result before using
    part and place, so that they are settled."""
    path = vocabulary or vocabulary_path()
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", n_tokens int, part int, place long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, me, seen = encoder(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            sizes, places = [], []
            for t in batch.column(text).to_pylist():
                n = count(coder, t) if t else 0
                places.append(seen.get(n, 0))
                seen[n] = places[-1] + 1
                sizes.append(n)
            columns = [batch.column(c) for c in keep] + [pa.array(sizes, pa.int32()), pa.array([me] * len(sizes), pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_tokens", "part", "place"])

    return spread(docs.select(*dict.fromkeys([*keep, text]))).mapInArrow(run, schema)
