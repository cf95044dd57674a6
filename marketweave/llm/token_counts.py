"""Token counts of documents without token ids.

A text is cut into pre-tokens where no piece of the model can cross: before a run of spaces and
around line feeds. The pieces of each distinct pre-token are counted once per task and joined to
the pre-token frequencies of every document; only sums leave the task.

The join is made inside each task. As a shuffled join it would move one row per document and
pre-token, several times the input, to look up numbers that the task can count itself.

Defined cases: a null or empty text has 0 tokens and 0 bytes; repeated rows each return a row; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

CACHE = 300_000
_spaced = re.compile(r" +[^ ]*|[^ ]+")


class PieceCounter:
    """Counts pieces per pre-token with a bounded table.

    It holds for models with identity normalisation, dummy prefix, escaped and kept white space,
    byte fallback and no piece with a space inside or a line feed; `check` tests that.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, int] = {}

    def check(self) -> None:
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any("\n" in p or re.search("[^▁]▁", p) for p in pieces) or self.model.encode("\n", out_type=str) != ["▁", "<0x0A>"] or self.model.encode(" a  b ", out_type=str) != ["▁", "▁a", "▁", "▁b", "▁"]:
            raise ValueError("pre-tokens of this model can't be counted one by one")

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-tokens of a text with their frequencies, and the number of line feeds.

        A pre-token that begins with a space stands with its first space dropped, as the model
        itself puts one before each text; one that begins a later line stands behind a line feed.
        """
        if not text:
            return Counter(), 0
        text = text.replace("▁", " ")
        if "  " in text or text[0] == " " or text[-1] == " " or "\n " in text or " \n" in text:
            keys = []
            for i, line in enumerate(text.split("\n")):
                keys += [p[1:] if p[0] == " " else "\n" + p for p in _spaced.findall(line if i else " " + line)]
            return Counter(keys), text.count("\n")
        lines = text.split("\n")
        keys = lines[0].split(" ")
        for line in lines[1:]:
            words = line.split(" ")
            if words[0]:
                words[0] = "\n" + words[0]
            else:
                words = words[1:]
            keys += words
        return Counter(keys), len(lines) - 1

    def learn(self, keys: set[str]) -> None:
        new = [k for k in keys if k not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known = {k: self.known[k] for k in keys if k in self.known}
        for key, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
            # the empty key is a lone space: the dummy prefix alone
            self.known[key] = len(ids) - 2 if key[:1] == "\n" else len(ids) if key else 1


def count(docs: DataFrame, model: str) -> DataFrame:
    """Per document: doc_id, n_bytes and n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceCounter(model)
        pieces.check()
        for batch in batches:
            n, size = [], []
            ids = batch.column("doc_id")
            waiting: list[tuple[Counter, int]] = []
            chars = 0

            def settle(waiting: list[tuple[Counter, int]]) -> list[int]:
                pieces.learn(set().union(*(c for c, _ in waiting)))
                known = pieces.known
                return [feeds + sum([known[k] * f for k, f in c.items()]) for c, feeds in waiting]

            for value in batch.column("text"):
                text = value.as_py() or ""
                size.append(len(text.encode()))
                waiting.append(pieces.frequencies(text))
                chars += len(text)
                if chars > 4_000_000:
                    n += settle(waiting)
                    waiting, chars = [], 0
            n += settle(waiting)
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "n_bytes": pa.array(size, pa.int64()), "n_tokens": pa.array(n, pa.int64())})

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
