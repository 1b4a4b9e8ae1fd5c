"""Exact encoding of a merge-type piece model by backtracking, and decoding."""

from __future__ import annotations

from array import array

from pyspark.sql import DataFrame

from .common import unused, with_field

#: Chunks, and pairs of pieces, that a Python worker remembers; beyond, it forgets all and starts anew.
CACHE_CHUNKS, CACHE_PAIRS = 600_000, 800_000
#: Positions whose matches are found in one scan of the automaton, and such scans held for one text.
SCAN, SCANS = 1024, 8
#: Rows whose ids are built before they leave the worker.
ROWS = 256
_SPACE, _LATIN, _NONE = "▁", "A-Za-zÀ-ɏ", float("-inf")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def merged(symbols: str, score: dict[str, float]) -> list[str]:
    """The pieces of a short string by definition: neighbours whose union has the best score are merged, leftmost first."""
    parts, get = list(symbols), score.get
    scores = [get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
    while scores and (best := max(scores)) != _NONE:
        at = scores.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del scores[at]
        if at:
            scores[at - 1] = get(parts[at - 1] + parts[at], _NONE)
        if at < len(scores):
            scores[at] = get(parts[at] + parts[at + 1], _NONE)
    return parts


class Chunks(dict):
    """The ids of chunks, as little-endian 32-bit integers; an unknown chunk is encoded when it is asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        found = self.encode(chunk)
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        if len(chunk) < 64:
            self[chunk] = found
        return found


class PieceModel:
    """Ids of whole texts, by backtracking over an Aho-Corasick automaton of the pieces.

    The merges' result is the one sequence of pieces whose neighbours are all compatible, that is, merging
    the union of two neighbours anew gives just these two. So a text is covered from the left by longest matches; a piece
    that does not go with the one before gives way to the next shorter one, and a position from which no piece goes on is
    marked in a bit field, so it is not tried again. Two pieces of one score are merged leftmost first, which the pair rule
    covers only for runs of the space mark; a model with other equal scores is refused.
    """

    made: dict[str, PieceModel] = {}

    def __init__(self, path: str):
        import re

        import ahocorasick
        import sentencepiece

        self.library = p = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_byte(i) or p.is_unknown(i) or p.is_unused(i))]
        self.ids = {p.id_to_piece(i): i for i in plain}
        self.score = {s: p.get_score(i) for s, i in self.ids.items()}
        apart = [v for s, v in self.score.items() if s.strip(_SPACE) and len(s) > 1]
        if len(set(apart)) < len(apart) or set(apart) & {v for s, v in self.score.items() if not s.strip(_SPACE)}:
            raise ValueError("pieces of equal scores: their order of merging is not a matter of pairs")
        # a piece that merging its own characters does not give stands in no encoding
        self.automaton = ahocorasick.Automaton()
        reached = [s for s in self.ids if len(s) == 1 or merged(s, self.score) == [s]]
        for s in reached:
            self.automaton.add_word(s, self.ids[s])
        self.automaton.make_automaton()
        # a character that is no piece goes as a piece of its own, numbered behind the others
        self.sizes, self.n = [len(p.id_to_piece(i)) for i in range(p.get_piece_size())], p.get_piece_size()
        self.longest = max(map(len, reached))
        # merges never cross a place where no piece has such two characters beside each other: before a space mark if none
        # goes on to it from another character, and between Latin letters and others if none has both
        rule = "(?s).+"
        if not any(re.search(f"[^{_SPACE}]{_SPACE}", s) for s in reached):
            mixed = any(re.search(f"[{_LATIN}][^{_LATIN}]|[^{_LATIN}{_SPACE}][{_LATIN}]", s) for s in reached)
            rule = f"{_SPACE}+[^{_SPACE}]*|[^{_SPACE}]+" if mixed else f"{_SPACE}*[{_LATIN}]+|{_SPACE}*[^{_LATIN}{_SPACE}]+|{_SPACE}+"
        self.chunks = re.compile(rule).findall
        self.bytes = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.by_bytes = all(map(p.is_byte, self.bytes))
        self.unknown, self.end = p.unk_id(), p.eos_id().to_bytes(4, "little")
        self.known = Chunks(self._chunk)
        self.pairs: dict[int, bool] = {}

    @classmethod
    def of(cls, path: str) -> PieceModel:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def string(self, piece: int) -> str:
        return self.library.id_to_piece(piece) if piece < self.n else chr(piece - self.n)

    def compatible(self, a: int, b: int, key: int) -> bool:
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        one, two = self.string(a), self.string(b)
        found = self.pairs[key] = merged(one + two, self.score) == [one, two]
        return found

    def _scan(self, text: str, first: int) -> list[list[int]]:
        """The pieces that begin at each of SCAN positions from first, shortest first."""
        n, sizes = min(SCAN, len(text) - first), self.sizes
        found: list[list[int]] = [[] for _ in range(n)]
        if n == len(text):
            for last, piece in self.automaton.iter(text):
                found[last + 1 - sizes[piece]].append(piece)
        else:
            for last, piece in self.automaton.iter(text, first, min(first + n + self.longest, len(text))):
                at = last + 1 - sizes[piece] - first
                if at < n:
                    found[at].append(piece)
        return found

    def split(self, text: str) -> list[int]:
        """The pieces of a chunk."""
        size, sizes, n, pairs = len(text), self.sizes, self.n, self.pairs
        scans = {0: self._scan(text, 0)}
        near = scans[0]

        def far(at: int) -> list[int]:
            k = at // SCAN
            if k not in scans:
                if len(scans) >= SCANS:
                    scans.pop(min(scans))
                scans[k] = self._scan(text, k * SCAN)
            return scans[k][at - k * SCAN]

        failed = bytearray(size // 8 + 1)
        tried_again = False
        pieces: list[int] = []
        # for each piece, which of those that begin at its place it is
        choices: list[int] = []
        at, choice, before = 0, -1, -1
        while at < size:
            some = (near[at] if at < SCAN else far(at)) or [n + ord(text[at])]
            if choice == -1:
                choice = len(some)
            while choice:
                piece = some[choice - 1]
                if tried_again:
                    end = at + (sizes[piece] if piece < n else 1)
                    if failed[end >> 3] >> (end & 7) & 1:
                        choice -= 1
                        continue
                if before < 0:
                    break
                key = before << 21 | piece
                good = pairs.get(key)
                if self.compatible(before, piece, key) if good is None else good:
                    break
                choice -= 1
            if choice:
                pieces.append(piece)
                choices.append(choice)
                at += sizes[piece] if piece < n else 1
                choice, before = -1, piece
            elif pieces:
                failed[at >> 3] |= 1 << (at & 7)
                tried_again = True
                piece = pieces.pop()
                at -= sizes[piece] if piece < n else 1
                choice = choices.pop() - 1
                before = pieces[-1] if pieces else -1
            else:
                raise AssertionError("no sequence of compatible pieces")
        return pieces

    def _chunk(self, chunk: str) -> bytes:
        ids = self.split(chunk)
        if max(ids) >= self.n:
            pieces, ids = ids, []
            for i in pieces:
                if i < self.n:
                    ids.append(i)
                elif self.by_bytes:
                    ids.extend(self.bytes[b] for b in chr(i - self.n).encode())
                elif ids[-1:] != [self.unknown]:  # neighbours that are unknown are one piece
                    ids.append(self.unknown)
        return array("i", ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text and the end id, as little-endian 32-bit integers; a null text is empty."""
        return b"".join(map(self.known.__getitem__, self.chunks(self.library.normalize(text or "")))) + self.end


def encode_pieces(docs: DataFrame, model: str | None = None) -> DataFrame:
    """docs, all columns, and ids: the pieces of the whole text and the end id, as the model's own library gives them.

    Rows keep their tasks, so nothing is shuffled, and a text never leaves its row. A null or empty text has
    the end id alone; repeated rows are encoded each; no rows, no rows. Where docs has a column ids, the new one
    is called ids_ (and so on).
    """
    path, name = model or default_pieces(), unused(docs, "ids")
    at = docs.columns.index("text")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        coder = PieceModel.of(path)
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                some = b.slice(k, ROWS)
                ids = [coder.encode(x.as_py()) for x in some.column(at)]
                offsets = np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int32)
                flat = np.frombuffer(b"".join(ids), np.int32)
                yield pa.record_batch([*some.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[*some.schema.names, name])

    return docs.mapInArrow(run, with_field(docs, name, "array<int>"))


def decode_pieces(coded: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """coded, all columns, and decoded: the text that the ids stand for, by the model's own library.

    Null ids give null. Where coded has a column decoded, the new one is called decoded_ (and so on).
    """
    path, name, at = model or default_pieces(), unused(coded, "decoded"), coded.columns.index(ids)

    def run(batches):
        import pyarrow as pa

        library = PieceModel.of(path).library
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                some = b.slice(k, ROWS)
                texts = [x if x is None else library.decode(x) for x in some.column(at).to_pylist()]
                yield pa.record_batch([*some.columns, pa.array(texts, pa.string())], names=[*some.schema.names, name])

    return coded.mapInArrow(run, with_field(coded, name, "string"))
