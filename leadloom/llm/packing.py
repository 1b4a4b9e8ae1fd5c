"""Best-fit packing: documents to token pieces, pieces to sequences, by hierarchical residual packing."""

from __future__ import annotations

import zlib
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

CAPACITY = 2048
#: A sequence with no more free tokens than this is nearly full and is emitted.
SLACK = 4
#: Pieces that one task packs in a round.
TASK_ROWS = 20_000
#: Words whose ids a Python worker remembers; beyond, it forgets all and starts anew.
CACHE_WORDS = 1_500_000
_MARK = "\x01"
_TAIL = ".,;:!?"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of whole texts. The tokenizer drops white space, so a text's ids are its words' ids in a row,
    and each distinct word is encoded once; the ids of known words stand one after the other in one array."""

    made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.lengths, self.ids = array("q"), array("i"), array("I")

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    @staticmethod
    def parts(word: str) -> tuple[str, ...]:
        """The word's parts that the tokenizer surely splits and folds alike: lower case if ASCII, closing marks apart."""
        if word.isascii() and "<|" not in word:
            word = word.lower()
        stem = word.rstrip(_TAIL)
        if stem != word and stem and stem[-1].isalnum() and ord(stem[-1]) < 0x180 and ord(stem[-1]) != 0x130:
            return stem, word[len(stem) :]
        return (word,)

    def _add(self, word: str, ids: bytes) -> None:
        self.place[word] = len(self.starts)
        self.starts.append(len(self.ids))
        self.lengths.append(len(ids) // 4)
        self.ids.frombytes(ids)

    def _encode(self, words: list[str]) -> None:
        import numpy as np

        plain = [w for w in words if _MARK not in w]
        for i in range(0, len(plain), 4000):
            some = plain[i : i + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {_MARK} ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark)
            raw = ids.tobytes()
            for w, s, e in zip(some, [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)]):
                self._add(w, raw[s:e])
        for w in set(words) - set(plain):
            self._add(w, np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes())

    def _raw(self, word: str) -> bytes:
        k = self.place[word]
        return self.ids[self.starts[k] : self.starts[k] + self.lengths[k]].tobytes()

    def encode(self, texts) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; a null text has none. texts: a list or Arrow array.

        Words are split and made distinct by Arrow, looked up once each, and their ids gathered with numpy.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        ends = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        known, code = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        if len(self.place) > CACHE_WORDS:
            self.forget()
        if new := [w for w in known if w not in self.place]:
            split = {w: self.parts(w) for w in new}
            self._encode(list({p for ps in split.values() for p in ps if p not in self.place}))
            for w, ps in split.items():
                if w not in self.place:
                    self._add(w, b"".join(map(self._raw, ps)))
        at = np.fromiter(map(self.place.__getitem__, known), np.int64, len(known))[code]
        starts, lengths, ids = np.frombuffer(self.starts, np.int64), np.frombuffer(self.lengths, np.int32), np.frombuffer(self.ids, np.uint32)
        n = lengths[at]
        sums = np.r_[0, np.cumsum(n, dtype=np.int64)]
        found = ids[np.repeat(starts[at] - sums[:-1], n) + np.arange(sums[-1])] if len(at) else ids[:0]
        cuts = sums[ends].tolist()
        return [found[s:e].tobytes() for s, e in zip(cuts, cuts[1:])]


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each row's ids and a closing 0, cut every capacity tokens."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        import pyarrow as pa

        encoder = Encoder.of(path)
        for b in batches:
            out = []
            for k in range(0, b.num_rows, 2048):
                some = b.slice(k, 2048)
                for doc, raw in zip(some.column(0).to_pylist(), encoder.encode(some.column(1))):
                    raw += b"\0\0\0\0"
                    for i in range(0, len(raw), 4 * capacity):
                        cut = raw[i : i + 4 * capacity]
                        out.append((doc, i // (4 * capacity), i // 4, len(cut) // 4, zlib.crc32(cut)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"]) if out else pa.record_batch(
                [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes, capacity: int) -> list[int]:
    """The bin of each item, largest first into the fullest bin that takes it. sizes: descending.

    open_ has a bit for each amount of space that some bin has left, so the best one is its lowest bit from the size up.
    """
    bins: list[int] = []
    by_space: dict[int, list[int]] = {}
    open_, n = 0, 0
    for size in sizes:
        fits = open_ >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            at = by_space[space].pop()
            if not by_space[space]:
                open_ ^= 1 << space
        else:
            space, at, n = capacity, n, n + 1
        bins.append(at)
        if left := space - size:
            by_space.setdefault(left, []).append(at)
            open_ |= 1 << left
    return bins


def _repack(pdf, capacity: int):
    """Best fit over the bins of one task; pieces keep their order inside a bin that becomes part of another."""
    import numpy as np

    bins, item = np.unique(pdf["bin"].to_numpy(), return_inverse=True)
    fill = np.bincount(item, pdf["length"].to_numpy()).astype(int)
    order = np.lexsort((bins, -fill))
    put = np.array(best_fit(fill[order].tolist(), capacity))
    by = np.lexsort((np.arange(len(put)), put))
    sizes, group = fill[order][by], put[by]
    first = np.r_[True, group[1:] != group[:-1]]
    run = np.cumsum(sizes) - sizes
    base = run - np.repeat(run[first], np.diff(np.flatnonzero(np.r_[first, True])))
    new_bin, offset = np.empty(len(bins), np.int64), np.empty(len(bins), np.int64)
    new_bin[order[by]] = np.repeat(bins[order[by]][first], np.diff(np.flatnonzero(np.r_[first, True])))
    offset[order[by]] = base
    total = np.bincount(put, fill[order]).astype(int)
    space = np.empty(len(bins), np.int64)
    space[order] = capacity - total[put]
    return pdf.assign(bin=new_bin[item], offset=pdf["offset"].to_numpy() + offset[item], space=space[item])


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, slack: int = SLACK, task_rows: int = TASK_ROWS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece of docs (doc_id, text).

    Each round deals the underfull bins anew to tasks of about task_rows pieces, packs each task's bins as
    items by best fit, and emits the nearly full ones; fewer tasks remain from round to round. It ends when one
    task is left or a round saves no bin. Null and empty texts are one piece of the closing
    token; repeated rows are packed each; a null doc_id stays null; an empty table gives no rows.
    """
    pieces = stored(token_pieces(docs, tokenizer, capacity).withColumn("bin", F.monotonically_increasing_id()), "pack-pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "space"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, space long"
    items = pieces.withColumns({"offset": F.lit(0).cast("long"), "space": capacity - F.col("length")}).select(*names)
    done = items.where(F.col("space") <= slack)
    open_ = items.where(F.col("space") > slack)
    rows = bins = open_.count()
    turn = 0
    while rows:
        tasks = -(-rows // task_rows)
        turn += 1
        packed = stored(
            open_.withColumn("task", F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(tasks)))
            .groupBy("task").applyInPandas(lambda pdf: _repack(pdf, capacity).drop(columns="task")[names], schema),
            "pack-round",
        )
        done = done.unionByName(packed.where(F.col("space") <= slack))
        open_ = packed.where(F.col("space") > slack)
        rows, left = open_.agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        if tasks == 1 or left >= bins:
            break
        bins = left
    return done.unionByName(open_).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
