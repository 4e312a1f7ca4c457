"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Segments kept in each of a worker's two generations of encoded segments, and the longest that is kept.
KEPT, LONGEST = 250_000, 64
#: Up to so many symbols, the agenda is a plain list.
SHORT = 40
NEVER = float("inf")


def default_model() -> str:
    """Path of the 32k piece vocabulary among the machine's public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Merger:
    """Encodes by a score-ordered agenda of adjacent symbol pairs, segment by segment.

    A text is cut before every run of spaces that follows something else, and around line ends if the vocabulary
    has no longer piece with one: no piece spans such a cut, so no merge does.  That makes the encoding
    of a segment independent of its surroundings; recently seen segments are remembered, up to a bound.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or kinds & {USER, UNUSED} or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path} is not a plain merge-type vocabulary")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or not rules.add_dummy_prefix:
            raise ValueError(f"{path} changes its input, which is not supported")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.ranks = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        self.text = [str(i) for i in range(len(model.pieces))].__getitem__
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.bytes = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        self.fallback = BYTE in kinds
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError(f"{path} has pieces across words, which is not supported")
        ends = "" if any("\n" in p and len(p) > 1 for p in self.ids) else "\n"
        self.cuts = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if ends else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.fresh: dict[str, tuple[int, ...]] = {}

    def merge(self, segment: str) -> tuple[int, ...]:
        """Ids of a segment: the pair with the best score merges first, of equal ones the leftmost."""
        symbols = list(segment)
        if len(symbols) > SHORT:
            symbols = self._merge_long(symbols)
        else:
            # a list is the faster agenda while it is short: its first minimum is the leftmost best pair
            ranks = self.ranks.get
            agenda = [ranks(a + b, NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
            while agenda and (best := min(agenda)) < NEVER:
                i = agenda.index(best)
                del agenda[i]
                joined = symbols[i] = symbols[i] + symbols.pop(i + 1)
                if i < len(agenda):
                    agenda[i] = ranks(joined + symbols[i + 1], NEVER)
                if i:
                    agenda[i - 1] = ranks(symbols[i - 1] + joined, NEVER)
        out: list[int] = []
        for s in symbols:
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.fallback:
                out.extend(map(self.bytes.__getitem__, s.encode("utf-8")))
            else:
                out.append(self.unknown)
        return tuple(out)

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap and links to neighbours, for a segment of any length."""
        ranks, n = self.ranks, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(ranks[pair], i, len(pair)) for i in range(n - 1) if (pair := symbols[i] + symbols[i + 1]) in ranks]
        heapq.heapify(agenda)
        while agenda:
            _, i, size = heapq.heappop(agenda)
            j = after[i] if symbols[i] else n
            if j >= n or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one of the two has merged with another symbol meanwhile
            symbols[i] += symbols[j]
            symbols[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (pair := symbols[i] + symbols[k]) in ranks:
                    heapq.heappush(agenda, (ranks[pair], i, len(pair)))
            h = before[i]
            if h >= 0 and (pair := symbols[h] + symbols[i]) in ranks:
                heapq.heappush(agenda, (ranks[pair], h, len(pair)))
        return [s for s in symbols if s]

    def segment(self, s: str) -> tuple[int, ...]:
        """Ids of a segment that ``new`` does not have."""
        ids = self.old.get(s)
        if ids is None:
            ids = self.fresh[s] = self.merge(s)
        if len(s) <= LONGEST:
            self.new[s] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        known, more = self.new, self.segment
        return list(chain.from_iterable([known.get(s) or more(s) for s in self.cuts(SPACE + text.replace(" ", SPACE))]))

    def check(self) -> None:
        """Hold all segments merged since the last check against the library, then forget the oldest ones."""
        fresh, self.fresh = self.fresh, {}
        words, ends = [s for s in fresh if s[0] == SPACE], [s for s in fresh if s[0] != SPACE]
        same = self.library.encode([s[1:] if len(s) > 1 else "\n" for s in words], num_threads=1) if words else []
        line = self.library.encode("\n", num_threads=1)
        for s, ids in zip(words, same, strict=True):
            want = ids if len(s) > 1 else ids[:1]
            if list(fresh[s]) != want:
                raise ValueError(f"{s!r} was encoded as {fresh[s]}; the library has {want}")
        same = self.library.encode(["\n" + s for s in ends], num_threads=1) if ends else []
        for s, ids in zip(ends, same, strict=True):
            if [*line, *fresh[s]] != ids:
                raise ValueError(f"{s!r} was encoded as {fresh[s]}; the library has {ids}")
        if len(self.new) > KEPT:
            self.old, self.new = self.new, {}


@cache
def merger(path: str) -> Merger:
    """One for each worker and model."""
    return Merger(path)


def round_trip(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text without begin or end ids and decode the ids again.

    Returns ``doc_id``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas), ``decoded_sha256`` (of
    the decoded text in UTF-8) and, if asked for, ``ids``.  Ids come from the agenda of ``Merger``; in every
    Arrow batch all segments that the agenda met anew are held against the sentencepiece library, and a
    difference fails the task.  Decoding is the library's.  Rows are independent, so nothing is shuffled, and a
    lost executor costs its own batches only.

    A null text counts as empty: no tokens and the digests of empty strings.  Repeated rows and null ids keep a
    row each; an empty table gives an empty result; further columns are not read.
    """
    path = model or default_model()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for part in parts:
            for at in range(0, part.num_rows, 500):
                few = part.slice(at, 500)
                ids = [m.encode(t or "") for t in few.column(1).to_pylist()]
                m.check()
                decoded = m.library.decode(ids, num_threads=1) if ids else []
                columns = [
                    few.column(0),
                    pa.array(map(len, ids), pa.int64()),
                    pa.array([sha256(",".join(map(m.text, x)).encode()).hexdigest() for x in ids]),
                    pa.array([sha256(x.encode()).hexdigest() for x in decoded]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
