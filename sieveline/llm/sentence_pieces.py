"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces and one pass of dynamic programming.

At each character the pieces that end there are read along the automaton's output links. A unigram model keeps the best
sum of scores (Viterbi). A BPE model keeps the one piece that its merges leave last: pieces in a row are the merges' result
if and only if each two neighbours are, so a table of pairs decides. Every text is decoded again and compared in the same pass.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The sign that stands for a blank.
MARK = "▁"
#: Segments and pairs of pieces that a worker remembers, and rows that it returns at once.
CACHE_SEGMENTS, CACHE_PAIRS, ROWS = 500_000, 500_000, 500
#: The longest segment that is remembered.
LONGEST = 64
#: Pairs of pieces are numbers: the left piece times this, and the right one. Signs that are no piece follow the pieces' ids.
_STEP = 1 << 22
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"
_LETTER = "[A-Za-z\u00c0-\u024f]"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A model's pieces: ids of texts and bytes of ids, as the sentencepiece library gives them."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        kinds = [p.type for p in model.pieces]
        spec, of = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        self.bpe = model.trainer_spec.model_type == 2
        if model.trainer_spec.model_type not in (1, 2) or of.USER_DEFINED in kinds or of.UNUSED in kinds:
            raise ValueError("only unigram and BPE models without user-defined and unused pieces are known")
        if not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("only models that mark blanks before words, and decode without a map of characters, are known")
        self.prefix, self.strip_all = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.plain = not spec.precompiled_charsmap and not self.strip_all
        self.processor = None if self.plain else sentencepiece.SentencePieceProcessor(model_file=path)
        self.unknown = kinds.index(of.UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == of.BYTE}
        self.is_byte = np.array([k == of.BYTE for k in kinds])
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == of.NORMAL}
        self.scores = [p.score for p in model.pieces]
        self.unknown_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        self.lengths = [len(p.piece) for p in model.pieces]
        surface = {of.NORMAL: lambda p: p.piece.replace(MARK, " ").encode(), of.BYTE: lambda p: bytes([int(p.piece[3:5], 16)]), of.UNKNOWN: lambda p: model.trainer_spec.unk_surface.encode()}
        self.surfaces = [surface.get(p.type, lambda p: b"")(p) for p in model.pieces]
        self.names = [p.piece for p in model.pieces]
        # Where no piece goes on, a text is cut without loss: before blanks, at line ends, between letters and ASCII signs.
        # Each cut is made only if no piece of the model spans it.
        sign, letter = f"[{re.escape(_SIGNS)}]", _LETTER
        marks = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        lines = not any("\n" in p for p in self.ids if len(p) > 1)
        if marks and lines and not any(re.search(f"{sign}{letter}|{letter}{sign}", p) for p in self.ids):
            rest = rf"[^{MARK}\n]"
            word = rf"{letter}++(?=[{MARK}\n]|{sign}|\Z)|{sign}++(?=[{MARK}\n]|{letter}|\Z)|{rest}(?:(?<={letter})(?!{sign}){rest}|(?<={sign})(?!{letter}){rest}|(?<!{letter})(?<!{sign}){rest})*"
            pattern = rf"{MARK}*(?:{word})|{MARK}+|\n"
        else:
            no = (MARK if marks else "") + ("\n" if lines else "")
            pattern = (rf"{MARK}+[^{no}]*|" if marks else "") + (rf"[^{no}]+" if no else r".+") + (r"|\n" if lines else "")
        self.segments = re.compile(pattern, re.S).findall
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.size = len(kinds)
        self._automaton()

    def _automaton(self) -> None:
        """Nodes as next[node][sign], fail[node]; piece[node] ends at the node, and link[node] is the next node with a shorter one."""
        self.next: list[dict[str, int]] = [{}]
        self.piece = [-1]
        for text, i in self.ids.items():
            at = 0
            for c in text:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.piece.append(-1)
                at = to
            self.piece[at] = i
        self.fail, self.link = [0] * len(self.next), [0] * len(self.next)
        queue = list(self.next[0].values())
        for node in queue:
            for c, to in self.next[node].items():
                back = self.fail[node]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[to] = back = self.next[back].get(c, 0)
                self.link[to] = back if self.piece[back] >= 0 else self.link[back]
                queue.append(to)
        self.first = [node if i >= 0 else self.link[node] for node, i in enumerate(self.piece)]
        self.width = [self.lengths[i] if i >= 0 else 0 for i in self.piece]

    def merged(self, text: str) -> list[str]:
        """The merges' result on a short text: the best pair first, of equal ones the first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _joined(self, left: int, right: int) -> bool:
        """True if the merges leave the two pieces as they are. -1 is no piece, numbers from `size` on are signs that are none."""
        names = [self.names[x] if x < self.size else chr(x - self.size) for x in (left, right) if x >= 0]
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[left * _STEP + right] = kept = self.merged("".join(names)) == names
        return kept

    def _last_merged(self, text: str) -> list[int]:
        """Of each beginning of a segment, the piece that a BPE model's merges leave last."""
        nxt, fail, link, piece, first, width, ids, pairs = self.next, self.fail, self.link, self.piece, self.first, self.width, self.ids, self.pairs
        last, node = [-1], 0
        for end, c in enumerate(text, 1):
            to = nxt[node].get(c)
            while to is None and node:
                node = fail[node]
                to = nxt[node].get(c)
            node = to or 0
            at = first[node]
            while at:
                i = piece[at]
                left = last[end - width[at]]
                kept = pairs.get(left * _STEP + i)
                if kept or kept is None and self._joined(left, i):
                    last.append(i)
                    break
                at = link[at]
            else:
                if c in ids:
                    raise RuntimeError("no piece ends at a sign")
                last.append(self.size + ord(c))
        return last

    def _last_best(self, text: str) -> list[int]:
        """Of each beginning of a segment, the last piece of the best sum of scores (Viterbi); of equal sums, the longest piece's."""
        nxt, fail, link, piece, first, width, ids, scores = self.next, self.fail, self.link, self.piece, self.first, self.width, self.ids, self.scores
        last, best, node = [-1], [0.0], 0
        for end, c in enumerate(text, 1):
            to = nxt[node].get(c)
            while to is None and node:
                node = fail[node]
                to = nxt[node].get(c)
            node = to or 0
            at, found, top = first[node], -1, 0.0
            while at:
                score = best[end - width[at]] + scores[piece[at]]
                if found < 0 or score > top:
                    found, top = piece[at], score
                at = link[at]
            if c not in ids and (found < 0 or best[end - 1] + self.unknown_score > top):
                found, top = self.size + ord(c), best[end - 1] + self.unknown_score
            last.append(found)
            best.append(top)
        return last

    def _ids_of(self, text: str) -> bytes:
        """Ids of a segment, read backwards from its end; a sign that is no piece is its bytes, or unknown."""
        last, end, out = self._last_merged(text) if self.bpe else self._last_best(text), len(text), array("I")
        while end:
            x = last[end]
            if x < self.size:
                out.append(x)
                end -= self.lengths[x]
                continue
            end -= 1
            if self.bytes:
                out.extend(self.bytes[b] for b in reversed(chr(x - self.size).encode()))
            else:
                out.append(self.unknown)
        out.reverse()
        return out.tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        if not self.plain:
            text = self.processor.normalize(text)
        elif text:
            text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        parts, known = self.segments(text), self.known
        try:
            found = b"".join(map(known.__getitem__, parts))
        except KeyError:
            new = {p: known[p] if p in known else self._ids_of(p) for p in set(parts)}
            found = b"".join(map(new.__getitem__, parts))
            if len(known) > CACHE_SEGMENTS:
                known.clear()
            known.update((p, x) for p, x in new.items() if p not in known and len(p) <= LONGEST)
        ids = np.frombuffer(found, np.uint32).astype(np.int32)
        if not self.bytes and len(ids):  # signs in a row that are no piece are one unknown piece
            ids = ids[~((ids == self.unknown) & (np.concatenate(([-1], ids[:-1])) == self.unknown))]
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, in UTF-8."""
        listed, first, head = ids.tolist(), 0, b""
        # The blank that encoding put before the text goes, or all blanks where encoding takes them; those of other pieces stay.
        while (self.prefix or self.strip_all) and first < len(listed) and not head and self.names[listed[first]].startswith(MARK):
            head = self.surfaces[listed[first]][1:]
            first += 1
            if not self.strip_all:
                break
        return head + b"".join(map(self.surfaces.__getitem__, listed[first:]))


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The model's pieces, read once in a worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def coded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids, n_ids, n_byte_ids, ids_crc32 (of little-endian 32-bit ids) and round_trip of every text.

    round_trip says that decoding the ids gives the text's own bytes; it fails where the model cannot keep a text, such as
    one that holds the sign for a blank or broken UTF-8. Null texts are empty and have no ids. Repeated rows and null ids are
    coded like any others, each in its own row; extra columns are ignored; an empty table gives no rows.
    """
    path = model or default_model()

    def code(batches):
        own = pieces(path)
        for b in batches:
            for k in range(0, len(b), ROWS):
                rows = []
                for doc, raw in zip(b["doc_id"][k : k + ROWS], b["text"][k : k + ROWS], strict=True):
                    raw = bytes(raw) if raw is not None else b""
                    ids = own.encode(raw.decode("utf-8", "replace"))
                    rows.append((None if doc is None else int(doc), ids, len(ids), int(own.is_byte[ids].sum()), zlib.crc32(ids.tobytes()), own.decode(ids) == raw))
                out = pd.DataFrame(rows, columns=["doc_id", "ids", "n_ids", "n_byte_ids", "ids_crc32", "round_trip"], dtype=object)
                yield out.assign(doc_id=pd.array(out["doc_id"], "Int64")).astype({"n_ids": "int64", "n_byte_ids": "int64", "ids_crc32": "int64", "round_trip": bool})

    # Ids pass as text: pandas would turn a column of numbers with nulls into doubles.
    texts = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInPandas(code, "doc_id long, ids array<int>, n_ids long, n_byte_ids long, ids_crc32 long, round_trip boolean")
