"""Packing: length combinations with repeat counts from non-negative least squares.

Documents are tokenised once and cut into whole windows and a remainder. The histogram of remainder lengths, at most
one bin per length, decides once how often each shallow combination of lengths that fills a window is used. Blocks of
pieces of bounded size then draw their share of each combination, rounded, and pack what is left best-fit first.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, written

#: UTF-8 bytes of text that a worker encodes at once, and forms of words that it remembers, each of at most FORM_BYTES:
#: all it holds is of this order, whatever the vocabulary.
CHUNK_BYTES, CACHE_FORMS, FORM_BYTES = 4 << 20, 200_000, 40
#: Pieces that one block packs.
BLOCK_PIECES = 20_000
#: ASCII signs, which never share a token with a word before them.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words of Latin letters that keep their number in lower case and in composed form.
_PLAIN = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+$"
_BLANK = re.compile(r"[\x20\x09-\x0D]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _gathered(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs values[first : first + count], one after the other."""
    taken = np.repeat(first - (np.cumsum(counts) - counts), counts)
    taken += np.arange(len(taken))
    return values[taken]


class Encoder:
    """Ids of whole texts, the end id included. This tokenizer drops white space and no token spans it, so a text's ids are
    its words' ids in a row. Each different word of a chunk of texts is encoded once; the forms met last are remembered."""

    def __init__(self, path: str, eos: int):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.eos = np.array([eos], np.uint32)
        # Lower-case words of Latin letters need neither normalising nor patterns: the same model reads them parted by blanks.
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known, self.known_ids = pa.array([], pa.string()), np.empty(0, np.uint32)
        self.known_first = self.known_counts = np.empty(0, np.int64)

    def _encoded(self, forms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different forms, and each form's first place and number of ids there.

        Words of letters alone end in exactly one closing token, so many are encoded in one text and told apart by it.
        """
        plain = pc.match_substring_regex(forms, _PLAIN)
        words, others = forms.filter(plain).to_pylist(), forms.filter(pc.invert(plain)).to_pylist()
        encode = lambda of, texts: [np.array(e.ids, np.uint32) for e in of.encode_batch_fast(texts, add_special_tokens=False)]
        found: list[np.ndarray] = []
        for i in range(0, len(words), 64 * 256):
            found += encode(self.letters, [" ".join(words[j : j + 64]) for j in range(i, min(len(words), i + 64 * 256), 64)])
        ids = np.concatenate(found) if found else np.empty(0, np.uint32)
        ends = np.flatnonzero(self.closing[ids]) + 1
        if len(ends) != len(words) or len(ids) and ends[-1] != len(ids):
            raise RuntimeError("the tokenizer closes no token at the end of a word")
        rest = [x for i in range(0, len(others), 4096) for x in encode(self.tokenizer, others[i : i + 4096])]
        counts, first = np.empty(len(forms), np.int64), np.empty(len(forms), np.int64)
        at = plain.to_numpy(zero_copy_only=False)
        counts[at], counts[~at] = np.diff(ends, prepend=0), [len(x) for x in rest]
        first[at], first[~at] = ends - counts[at], len(ids) + np.cumsum(counts[~at]) - counts[~at]
        return np.concatenate([ids, *rest]), first, counts

    def _forms(self, forms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As _encoded(), with what is remembered: the forms of this chunk, then those of earlier ones, up to the bound."""
        at = pc.index_in(forms, self.known)
        new = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy()
        ids, of_new, n_new = self._encoded(forms.filter(pa.array(new)))
        ids = np.concatenate([self.known_ids, ids])
        first, counts = np.empty(len(forms), np.int64), np.empty(len(forms), np.int64)
        first[new], counts[new] = of_new + len(self.known_ids), n_new
        first[~new], counts[~new] = self.known_first[at[~new]], self.known_counts[at[~new]]
        earlier = np.ones(len(self.known), bool)
        earlier[at[~new]] = False
        short = pc.less_equal(pc.binary_length(forms), FORM_BYTES)
        self.known = pa.concat_arrays([forms.filter(short), self.known.filter(pa.array(earlier))])[:CACHE_FORMS]
        short = short.to_numpy(zero_copy_only=False)
        kept_first, kept = np.concatenate([first[short], self.known_first[earlier]])[:CACHE_FORMS], np.concatenate([counts[short], self.known_counts[earlier]])[:CACHE_FORMS]
        self.known_ids, self.known_first, self.known_counts = _gathered(ids, kept_first, kept), np.cumsum(kept) - kept, kept
        return ids, first, counts

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) in a row, and the texts' offsets there."""
        listed = pc.ascii_split_whitespace(texts.fill_null(""))
        words = listed.flatten().dictionary_encode()
        distinct, word = words.dictionary, words.indices.to_numpy()
        # Signs after a word are tokens of their own, and case is dropped: stem and signs are forms of their own.
        head = pc.utf8_rtrim(distinct, _SIGNS)
        plain = pc.match_substring_regex(head, _PLAIN)
        tails = [w[len(h) :] if p else "" for w, h, p in zip(distinct.to_pylist(), head.to_pylist(), plain.to_pylist(), strict=True)]
        heads = pc.if_else(plain, pc.utf8_lower(head), distinct)
        forms = pa.concat_arrays([heads, pa.array(tails, distinct.type), pa.array([""], distinct.type)]).dictionary_encode()
        ids, first, counts = self._forms(forms.dictionary)
        form = forms.indices.to_numpy()
        # Each word is two forms, and each text ends in one more, the end id.
        ids, first, counts = np.concatenate((ids, self.eos)), np.append(first, len(ids)), np.append(counts, 1)
        per_text = pc.list_value_length(listed).to_numpy()
        ends = 2 * np.cumsum(per_text, dtype=np.int64) + np.arange(len(per_text))
        order = np.empty(2 * len(word) + len(per_text), np.int32)
        order[ends] = len(counts) - 1
        place = 2 * np.arange(len(word)) + np.repeat(np.arange(len(per_text)), per_text)
        order[place], order[place + 1] = form[word], form[len(distinct) + word]
        size = counts[order]
        return _gathered(ids, first[order], size), np.concatenate(([0], np.cumsum(size)[ends]))

    def long_ids(self, text: str) -> np.ndarray:
        """The ids of one long text, part by part between words."""
        out, start = [], 0
        while start < len(text):
            blank = _BLANK.search(text, start + CHUNK_BYTES // 4)
            stop = blank.start() if blank else len(text)
            out.append(self.ids(pa.array([text[start:stop]]))[0][:-1])
            start = stop
        return np.concatenate([*out, self.eos])


def pieces(docs: DataFrame, tokenizer: str | None = None, window: int = 4096, eos: int = 2) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each text's windows and remainder, with a row number to tell equal rows apart."""
    path = tokenizer or default_tokenizer()

    def rows(docs: pa.Table, ids: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        n = np.diff(offsets)
        of = np.repeat(np.arange(len(n)), -(-n // window))
        start = window * (np.arange(len(of)) - np.searchsorted(of, of))
        length = np.minimum(window, n[of] - start)
        raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
        sums = [zlib.crc32(raw[4 * i : 4 * (i + k)]) for i, k in zip((offsets[of] + start).tolist(), length.tolist(), strict=True)]
        taken = docs.select(["doc_id", "row"]).take(of)
        columns = [*(c.combine_chunks() for c in taken.columns), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(n[of])]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"])

    def cut(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(path, eos)
        held: list[pa.RecordBatch] = []

        def flush():
            if held:
                docs = pa.Table.from_batches(held)
                held.clear()
                yield rows(docs, *encoder.ids(docs["text"].combine_chunks()))

        size = 0
        for batch in batches:
            bytes_ = pc.binary_length(batch["text"]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < len(bytes_):
                if bytes_[at] > CHUNK_BYTES:
                    ids = encoder.long_ids(batch["text"][at].as_py())
                    yield rows(pa.Table.from_batches([batch.slice(at, 1)]), ids, np.array([0, len(ids)]))
                    at += 1
                    continue
                long = np.flatnonzero(bytes_[at:] > CHUNK_BYTES)
                until = at + long[0] if len(long) else len(bytes_)
                fits = int(np.searchsorted(np.cumsum(bytes_[at:until]), CHUNK_BYTES - size, "right"))
                if fits:
                    held.append(batch.slice(at, fits))
                    size += int(bytes_[at : at + fits].sum())
                    at += fits
                if at < until:
                    yield from flush()
                    size = 0
        yield from flush()

    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8("text").alias("text")).withColumn("row", F.monotonically_increasing_id())
    return numbered.mapInArrow(released(cut), "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(histogram: np.ndarray, window: int, bins: int = 64) -> list[tuple[int, ...]]:
    """Shallow combinations of length bins, largest first, that fill a window. A bin stands for its upper end.

    They hold up to four bins, or one bin as often as it fits and one more: some thousands for 64 bins.
    """
    width = window // bins
    used = [b for b in range(1, bins + 1) if histogram[(b - 1) * width + 1 : b * width + 1].sum()]
    out: set[tuple[int, ...]] = set()

    def grow(combo: tuple[int, ...], room: int) -> None:
        if combo and room == 0:
            out.add(combo)
            return
        if len(combo) == 4:
            return
        for b in used:
            if b <= room and (not combo or b <= combo[-1]) and (len(combo) < 2 or b == room or len(combo) == 2 and room - b <= b):
                grow((*combo, b), room - b)

    grow((), bins)
    for b in used:
        rest = bins % b
        out.add((b,) * (bins // b) + ((rest,) if rest in used else ()))
    return sorted(out)


def nonnegative(a: np.ndarray, y: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Repeat counts x >= 0 with a @ x as close to y as can be: least squares by active sets (Lawson and Hanson).

    No more columns than rows get a count. Rows weigh by the size of y. `rounds` bounds the columns tried.
    """
    x = np.zeros(a.shape[1])
    if not a.size:
        return x
    scale = np.sqrt(np.maximum(y, 1.0))
    a, y = a / scale[:, None], y / scale
    inside = np.zeros(len(x), bool)
    slack = 1e-9 * max(1.0, np.abs(a.T @ y).max())
    for _ in range(rounds):
        pull = np.where(inside, -np.inf, a.T @ (y - a @ x))
        j = int(pull.argmax())
        if pull[j] <= slack:
            break
        inside[j] = True
        while True:
            at = np.flatnonzero(inside)
            best = np.linalg.lstsq(a[:, at], y, rcond=None)[0]
            low = best <= 0
            if not low.any():
                break
            step = (x[at][low] / np.maximum(x[at][low] - best[low], 1e-300)).min()
            x[at] += step * (best - x[at])
            inside[at[low & (x[at] <= 1e-12)]] = False
            x[~inside] = 0.0
            if not inside.any():
                return x
        x[:] = 0.0
        x[at] = best
    return x


def plan(histogram: np.ndarray, window: int, bins: int = 64) -> list[tuple[tuple[int, ...], float]]:
    """(combination of bins, repeats per packed piece), largest pieces first."""
    width = window // bins
    counts = np.array([histogram[(b - 1) * width + 1 : b * width + 1].sum() for b in range(1, bins + 1)], float)
    combos = combinations(histogram, window, bins)
    a = np.zeros((bins, len(combos)))
    for j, combo in enumerate(combos):
        for b in combo:
            a[b - 1, j] += 1
    x = nonnegative(a, counts)
    total = max(counts.sum(), 1.0)
    return sorted(((c, float(r / total)) for c, r in zip(combos, x, strict=True) if r > 0), reverse=True)


class _Shelf:
    """Pieces by length, and the longest one that fits, by links from each empty length to the next shorter one."""

    def __init__(self, lengths: np.ndarray, window: int):
        self.at: list[list[int]] = [[] for _ in range(window)]
        for i in np.flatnonzero(lengths < window).tolist():
            self.at[lengths[i]].append(i)
        self.next = list(range(window))

    def fitting(self, room: int) -> int:
        """The longest length of at most `room` that some piece has, or 0."""
        n = room
        while n and not self.at[n]:
            if self.next[n] == n:
                self.next[n] = n - 1
            n = self.next[n]
        while room > n and self.next[room] > n:
            self.next[room], room = n, self.next[room]
        return n


def pack_block(lengths: np.ndarray, chosen: list[tuple[tuple[int, ...], float]], window: int, bins: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece of a block.

    Each combination is used as often as the plan says, rounded so that the sum over combinations keeps its size. A
    window takes the longest piece of each bin, and at last the longest ones that fit into the room that is truly left.
    Where lengths crowd at a bin's border, windows of bins can be poor: if best fit alone saves more than a hundredth of
    the sequences, its packing is returned.
    """
    loads = _loads(lengths, chosen, window, bins)
    if chosen and len(other := _loads(lengths, [], window, bins)) < 0.99 * len(loads) - 1:
        loads = other
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, load in enumerate(loads):
        start = 0
        for i in load:
            sequence[i], offset[i] = k, start
            start += int(lengths[i])
    return sequence, offset


def _loads(lengths: np.ndarray, chosen: list[tuple[tuple[int, ...], float]], window: int, bins: int) -> list[list[int]]:
    """The pieces of each sequence: planned windows, then best fit."""
    width = window // bins
    loads: list[list[int]] = [[i] for i in np.flatnonzero(lengths >= window).tolist()]
    shelf = _Shelf(lengths, window)
    owed = 0.0
    for combo, rate in chosen:
        owed += rate * len(lengths)
        times = int(owed + 0.5)
        owed -= times
        for _ in range(times):
            taken, room = [], window
            for k, b in enumerate(combo, 1):
                n = shelf.fitting(min(room, window - 1) if k == len(combo) else b * width)
                if n <= (b - 1) * width:
                    break
                taken.append(shelf.at[n].pop())
                room -= n
            # Bins stand for their upper ends, so many short pieces leave room for more of the kind.
            while len(taken) >= len(combo) and (n := shelf.fitting(min(room, window - 1))) > (combo[-1] - 1) * width:
                taken.append(shelf.at[n].pop())
                room -= n
            if taken:
                loads.append(taken)
            if len(taken) < len(combo):
                break
    # The rest by best fit: the longest piece first, into the fullest sequence that holds it.
    room = sorted((window - int(lengths[x].sum()), k) for k, x in enumerate(loads))
    for i in (i for n in range(window - 1, -1, -1) for i in shelf.at[n]):
        n = int(lengths[i])
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, k = room.pop(at)
            loads[k].append(i)
        else:
            free, k = window, len(loads)
            loads.append([i])
        if free - n:
            insort(room, (free - n, k))
    return loads


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = 4096, eos: int = 2) -> DataFrame:
    """Every piece of every text with its sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece that holds the end id alone. Repeated rows and null ids are packed like any
    others; extra columns are ignored; an empty table gives no rows. Pieces are never longer than a window, and a
    remainder is not cut again. A sequence is padded to the window unless its length is a power of two. The driver sees
    the histogram of lengths (at most `window` bins) and nothing of single documents.
    """
    cut = written(pieces(docs, tokenizer, window, eos), "pieces")
    rows = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `window` rows
    histogram = np.zeros(window + 1)
    for r in rows:
        histogram[r["length"]] = r["n"]
    chosen = plan(np.where(np.arange(window + 1) < window, histogram, 0), window)
    blocks = max(1, -(-int(histogram.sum()) // BLOCK_PIECES))
    # Whole windows need no partner and stay out of the shares; they still get their sequence in their block.
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def fill(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["row", "start"], kind="stable")
        lengths = b["length"].to_numpy()
        whole = lengths >= window
        sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
        sequence[~whole], offset[~whole] = pack_block(lengths[~whole], chosen, window)
        sequence[whole] = np.arange(whole.sum()) + (sequence[~whole].max() + 1 if (~whole).any() else 0)
        b = b.assign(sequence_id=sequence + (b["block"].to_numpy() << 32), offset=offset)
        return b[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    # Hashed rows spread evenly, so a block holds about BLOCK_PIECES rows whatever the documents are like.
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("row", "start"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(fill, schema)
