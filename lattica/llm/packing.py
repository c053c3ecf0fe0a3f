"""Best-fit packing under several capacities.

Documents are tokenised whole, one end id is added, and a text longer than the
capacity is cut into full pieces and a rest. A piece is a vector: tokens, documents (1)
and attention cost (its squared length). Pieces are dealt by hash into groups of a
bounded size; in each, in falling order of length, a piece goes to the open bin with
the smallest weighted residual norm (or the largest weighted dot product) among the
bins in which every capacity holds, and to a new bin where none does. A full piece is
a bin by itself.

Null and empty texts are a piece of one end id. Repeated rows are packed each for
themselves; extra columns are ignored. Groups lose at most one part-filled bin each,
so their size, not the table's, decides the waste.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, map_arrow, table, worker_cache, written

CAPACITY = 2048
#: Documents a sequence, so that a mask of their borders has a bounded size.
MAX_DOCS = 64
END_ID = 0
#: Pieces a group: bounds a packing task's memory and time.
GROUP_PIECES = 16_000
#: Words whose ids a worker keeps; the least recent half goes when it is full.
CACHE_WORDS = 600_000
#: ASCII marks that may close a word; the apostrophe is left out, as some letters behind it belong to it.
TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """ids of whole texts for a tokenizer that drops white space, so that words between ASCII white space are tokenised apart; words are kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # words of a-z alone are as they stand after the tokenizer's normaliser and split: the bare model does for them
        bare = json.loads(self.tok.to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        for t in (self.tok, self.bare):
            if hasattr(t.model, "_resize_cache"):
                t.model._resize_cache(0)  # words are kept here
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.closing = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab().items():
            self.closing[i] = token.endswith("</w>")
        self.kept: dict[bytes, bytes] = {}

    def _one_by_one(self, words: list[str]) -> None:
        for w, enc in zip(words, self.tok.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.kept[w.encode()] = np.array(enc.ids, "<u4").tobytes()

    def _encode(self, words: list[str]) -> None:
        """Words of letters are a pre-token each and go by hundreds in a text, to be parted again behind ids that close a word; all others go one by one."""
        letters = [w for w in words if w.isalpha()]
        self._joined([w for w in letters if w.isascii()], self.bare)
        self._joined([w for w in letters if not w.isascii()], self.tok)
        self._one_by_one([w for w in words if not w.isalpha()])

    def _joined(self, words: list[str], tok) -> None:
        kept = self.kept
        parts = [words[a : a + 200] for a in range(0, len(words), 200)]
        for part, enc in zip(parts, tok.encode_batch_fast([" ".join(x) for x in parts], add_special_tokens=False), strict=True):
            ids = np.array(enc.ids, "<u4")
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) != len(part):  # a letter that folds to more than letters parted a word
                self._one_by_one(part)
                continue
            data, a = ids.tobytes(), 0
            for w, b in zip(part, (4 * ends).tolist(), strict=True):
                kept[w.encode()] = data[a:b]
                a = b

    def _learn(self, words: set[bytes]) -> None:
        """Closing marks behind a letter or digit are a pre-token of their own, so a word's ids are its core's and theirs."""
        kept, joined, new = self.kept, [], set()
        for w in words:
            core = w.rstrip(TAIL)
            text = core.decode("utf-8", "replace")
            if len(core) == len(w):
                new.add(text)
            elif text[-1:].lower().isalpha() or text[-1:].isdigit() and text[-1:].isascii():  # a letter may fold to a letter and a mark
                joined.append((w, core))
                if core not in kept:
                    new.add(text)
                if w[len(core) :] not in kept:
                    new.add(w[len(core) :].decode())
            else:
                new.add(w.decode("utf-8", "replace"))
        self._encode(list(new))
        for w, core in joined:
            kept[w] = kept[core] + kept[w[len(core) :]]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        kept = self.kept
        if len(kept) > CACHE_WORDS:
            for w in list(kept)[: CACHE_WORDS // 2]:
                del kept[w]
        # capitals of A-Z fold before the split unless a text may hold a special token, which is matched as it stands
        out, new, get = [], set(), kept.get
        for t in texts:
            if any(s in t for s in self.special):
                out.append((None, t, None))
                continue
            words = t.lower().split()
            ids = list(map(get, words))
            missing = [i for i, x in enumerate(ids) if x is None]
            new.update([words[i] for i in missing])
            out.append((ids, words, missing))
        self._learn(new)
        for at, (ids, words, missing) in enumerate(out):
            if ids is None:
                out[at] = np.array(self.tok.encode(words.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
                continue
            for i in missing:
                ids[i] = kept[words[i]]
            out[at] = b"".join(ids)
        return out


def tokenizer(path: str) -> WordTokenizer:
    return worker_cache(f"tokenizer {path}", lambda: WordTokenizer(path))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document cut at the capacity."""
    end = np.array([END_ID], "<u4").tobytes()

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = as_bytes(batch.column(1))
        for a in range(0, len(texts), 64):
            out: dict[str, list] = {"row": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for i, ids in enumerate(tokenizer(path).ids(texts[a : a + 64]), a):
                ids += end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    for name, x in zip(out, (i, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[name].append(x)
            rows = out.pop("row")
            yield {"doc_id": batch.column(0).take(rows), "piece": pa.array(out.pop("piece"), pa.int32())} | out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", "tokenizer")


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; the pieces are taken longest first."""
    full = (float(capacity), float(max_docs or capacity), float(max_cost or capacity * capacity))
    bins, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room, names = np.zeros((3, 1024)), np.zeros(1024, np.int64)  # residual shares of the open bins
    n_open, n_bins, slack = 0, 0, 1e-12
    least = lengths.min() / capacity if len(lengths) else 0
    for at in np.argsort(-lengths, kind="stable").tolist():
        n = float(lengths[at])
        need = (n / full[0], 1.0 / full[1], n * n / full[2])
        chosen = -1
        if n < capacity and n_open:
            fits = np.flatnonzero(room[0, :n_open] >= need[0] - slack)
            left = room[:, fits]
            ok = (left[1] >= need[1] - slack) & (left[2] >= need[2] - slack)
            if not ok.all():
                fits, left = fits[ok], left[:, ok]
            if len(fits):
                if rule == "norm":
                    value = sum(w * (x - y) ** 2 for w, x, y in zip(weights, left, need, strict=True))
                else:
                    value = -sum(w * x * y for w, x, y in zip(weights, left, need, strict=True))
                chosen = int(fits[value.argmin()])
        if chosen < 0:
            if n_open == len(names):
                room, names = np.hstack([room, np.zeros_like(room)]), np.concatenate([names, np.zeros_like(names)])
            chosen, n_open = n_open, n_open + 1
            room[:, chosen], names[chosen] = 1.0, n_bins
            n_bins += 1
        bins[at], offset[at] = names[chosen], round((1.0 - room[0, chosen]) * capacity)
        room[:, chosen] -= need
        if room[0, chosen] < least - slack or room[1, chosen] < 1 / full[1] - slack or room[2, chosen] < -slack:  # nothing that is left fits: close it
            n_open -= 1
            room[:, chosen], names[chosen] = room[:, n_open], names[n_open]
    return bins, offset


def pack(parts: DataFrame, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_cost: int | None = None, rule: str = "norm", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """parts with sequence_id, offset and what the sequence leaves of each capacity: tokens_left, documents_left, cost_left. parts is written to the shared folder first, so texts are tokenised once."""
    full = (capacity, max_docs, max_cost or capacity * capacity)
    kept = written(parts, "pieces")
    groups = max(1, -(-kept.count() // group_pieces))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "ids_crc32", "piece"], ascending=[False, True, True], kind="stable")
        lengths = frame["length"].to_numpy(np.int64)
        bins, offset = best_fit(lengths, capacity, max_docs, max_cost, rule=rule)
        used = [np.bincount(bins, x) for x in (lengths, np.ones(len(lengths)), lengths.astype(float) ** 2)]
        left = {name: (c - u[bins]).astype(np.int64) for name, c, u in zip(("tokens_left", "documents_left", "cost_left"), full, used, strict=True)}
        return frame.drop(columns="pack_group").assign(sequence_id=bins * groups + int(key[0]), offset=offset, **left)

    dealt = kept.withColumn("pack_group", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(run, f"{fields}, sequence_id long, offset long, tokens_left long, documents_left long, cost_left long")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), vocabulary_path()))
