"""BPE encoding and decoding by speculation and verification.

The vocabulary is a tokenizers BPE file with word ends. Each word's tokens are first guessed by greedy longest
match. A guess is what exact merging gives if every token of it is what merging makes of the token's own string,
and every adjacent pair of tokens is compatible: merging the two strings together never joins across their
border. numpy tests all pairs of a batch at once by undoing merges from either side of the border; only words
with a failing pair undergo exact merging.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks of text between white space, and words, that a worker remembers before it forgets all of them.
REMEMBERED = 300_000
WHITE = "\t-\r \x85\xa0  -     　"
#: Words of more symbols than this are merged with a heap.
LONG = 100
#: Python's str.split() takes these for white space; the tokenizer doesn't.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
EXPECTED = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pre_tokenizer": ["Split", "ByteLevel"],
}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


class BpeCodec:
    def __init__(self, file: str):
        import regex

        spec = json.load(open(file, encoding="utf-8"))
        model = spec["model"]
        kinds = {
            "normalizer": [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])],
            "pre_tokenizer": [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])],
        }
        if kinds != EXPECTED or spec["decoder"] or model["type"] != "BPE" or model["byte_fallback"]:
            raise ValueError("not a word BPE file of the kind that this codec reads")
        self.suffix: str = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        # Tokens are numbered here by when merging makes them: single symbols first, then merges in order.
        made = {a + b for a, b in merges}
        self.symbols = [t for t in vocab if t not in made]
        self.of: dict[str, int] = {t: k for k, t in enumerate(self.symbols)}
        base = len(self.symbols)
        for a, b in merges:
            self.of[a + b] = len(self.of)
        if len(self.of) != base + len(merges):
            raise ValueError("two merges make the same token")
        n = len(self.of)
        self.left, self.right = np.arange(n), np.arange(n)
        for k, (a, b) in enumerate(merges):
            self.left[base + k], self.right[base + k] = self.of[a], self.of[b]
        keys = self.left[base:].astype(np.int64) << 32 | self.right[base:]
        order = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[order], order + base
        # For each token, the tokens that merge with it from the right, and when.
        nothing: dict[int, int] = {}
        self.joins = [nothing] * n
        for k, (a, b) in enumerate(merges):
            x = self.of[a]
            if self.joins[x] is nothing:
                self.joins[x] = {}
            self.joins[x][self.of[b]] = base + k
        self.vocab_id = np.array([vocab[t] for t in self.of], dtype="<u4")
        # For matching, a word's end is one letter that no byte stands for.
        self.end = "\x00"
        match = {(t[: -len(self.suffix)] + self.end if t.endswith(self.suffix) else t): k for t, k in self.of.items()}
        # All beginnings of tokens: those that are tokens with their number, others with -1.
        self.begin = dict.fromkeys((t[:n] for t in match for n in range(1, len(t))), -1)
        self.begin.update(match)
        self.begin[self.end] = -1  # the word's end is no token of its own
        self.letters = str.maketrans({b: c for b, c in enumerate(byte_letters())})
        self.cut = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
        self.gaps = regex.compile(f"[{WHITE}]+")
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.sound: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.exact = self.guessed = 0

    # -- one word

    def pieces(self, word: str) -> list[int]:
        """The symbols of a word: a letter for each byte, the last one with the word's end."""
        return [self.of[c] for c in word[:-1]] + [self.of[word[-1] + self.suffix]]

    def merged(self, tokens: list[int]) -> list[int]:
        """Exact merging: the earliest merge first, leftmost among equals."""
        if len(tokens) > LONG:
            return self.merged_long(tokens)
        joins, none = self.joins, 1 << 40
        tokens = list(tokens)
        ranks = [joins[a].get(b, none) for a, b in zip(tokens, tokens[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            tokens[k : k + 2] = (best,)
            del ranks[k]
            if k:
                ranks[k - 1] = joins[tokens[k - 1]].get(best, none)
            if k < len(ranks):
                ranks[k] = joins[best].get(tokens[k + 1], none)
        return tokens

    def merged_long(self, tokens: list[int]) -> list[int]:
        """The same with a heap and links, for words whose pairs aren't searched one by one."""
        joins, n, part = self.joins, len(tokens), list(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(joins[a][b], k, a, b) for k, (a, b) in enumerate(zip(part, part[1:])) if b in joins[a]]
        heapq.heapify(heap)
        while heap:
            made, k, a, b = heapq.heappop(heap)
            j = after[k]
            if part[k] != a or j >= n or part[j] != b:
                continue
            part[k], part[j] = made, -1
            q, p = after[j], before[k]
            after[k] = q
            if q < n:
                before[q] = k
                if part[q] in joins[made]:
                    heapq.heappush(heap, (joins[made][part[q]], k, made, part[q]))
            if p >= 0 and made in joins[part[p]]:
                heapq.heappush(heap, (joins[part[p]][made], p, part[p], made))
        return [t for t in part if t >= 0]

    def guess(self, word: str) -> list[int]:
        """Greedy longest match: as far as some token goes on, the last whole token on the way."""
        s, begin, k, out = word + self.end, self.begin.get, 0, []
        n, inner = len(s), len(word)
        while k < n:
            j, best, at = k + 1, -1, k
            t = begin(s[k:j])
            while t is not None:
                if t >= 0 and j != inner:
                    best, at = t, j
                j += 1
                if j > n:
                    break
                t = begin(s[k:j])
            if best < 0:
                return []
            out.append(best)
            k = at
        return out

    def is_sound(self, t: int) -> bool:
        """Whether merging makes this token of the token's own string."""
        if t not in self.sound:
            leaves, todo = [], [t]
            while todo:
                x = todo.pop()
                if self.left[x] == x:
                    leaves.append(x)
                else:
                    todo += [int(self.right[x]), int(self.left[x])]
            self.sound[t] = self.merged(leaves) == [t]
        return self.sound[t]

    # -- all pairs at once

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging never joins across their border.

        Walks the history of merges backwards: the later-made of the two tokens at the border is undone first,
        and a merge across the border is found if it came before what has been undone.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok, todo = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), 1 << 40, dtype=np.int64)
        while len(todo):
            x, y, most = a[todo], b[todo], limit[todo]
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            bad = (self.pair_keys[at] == key) & (self.pair_made[at] < most)
            ok[todo[bad]] = False
            go = ~bad
            x, y, todo = x[go], y[go], todo[go]
            lx, ly = self.right[x], self.left[y]
            can_x, can_y = lx != x, ly != y
            undo_x = np.where(can_x & can_y, x > y, can_x)
            a[todo], b[todo] = np.where(undo_x, lx, x), np.where(undo_x, y, ly)
            limit[todo] = np.where(undo_x, x, y + 1)
            todo = todo[can_x | can_y]
        return ok

    def learn(self, words: list[str]) -> None:
        """Encodes words that aren't remembered yet, all of a batch together."""
        if not words:
            return
        guesses = [self.guess(w) for w in words]
        sizes = np.array([len(g) for g in guesses])
        flat = np.array([t for g in guesses for t in g], dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        good = sizes > 0
        if len(flat):
            kinds, where = np.unique(flat, return_inverse=True)
            sound = np.array([self.is_sound(int(t)) for t in kinds])[where]
            good[owner[~sound]] = False
        if len(flat) > 1:
            same = owner[1:] == owner[:-1]
            a, b, who = flat[:-1][same], flat[1:][same], owner[:-1][same]
            if len(a):
                pairs, where = np.unique(a << 32 | b, return_inverse=True)
                good[who[~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[where]]] = False
        for w, g, fine in zip(words, guesses, good):
            self.words[w] = self.vocab_id[g if fine else self.merged(self.pieces(w))].tobytes()
        self.guessed += int(good.sum())
        self.exact += int((~good).sum())

    # -- texts

    def pretokens(self, chunk: str) -> list[str | int]:
        """Words of a chunk between white space, in letters for bytes; special strings as their ids."""
        # Letters alone, or with one sign after them, need no regular expression.
        head = chunk[:-1]
        if chunk.isalpha():
            plain: tuple[str, ...] = (chunk,)
        elif head.isalpha() and chunk[-1] in ".,;:!?":
            plain = (head, chunk[-1])
        else:
            plain = ()
        if plain and chunk.isascii():
            low = plain[0].lower()
            return [low, *plain[1:]]
        out: list[str | int] = []
        for part in self.parts.split(chunk) if "<|" in chunk else (chunk,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += [w.encode().decode("latin-1").translate(self.letters) for w in self.cut.findall(low)]
        return out

    def split(self, text: str) -> list[str]:
        return [x for x in self.gaps.split(text) if x] if any(c in text for c in ODD) else text.split()

    def forget(self) -> None:
        self.words, self.chunks = {}, {}

    def encode_batch(self, texts: list[str], remembered: int = REMEMBERED) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.chunks) > remembered:
            self.chunks.clear()
        if len(self.words) > remembered:
            self.words.clear()
        split = [self.split(t) for t in texts]
        new = {c: self.pretokens(c) for c in set().union(*map(set, split)) - self.chunks.keys()} if split else {}
        self.learn(list({w for p in new.values() for w in p if isinstance(w, str)} - self.words.keys()))
        for c, p in new.items():
            self.chunks[c] = b"".join(self.words[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in p)
        return [b"".join(map(self.chunks.__getitem__, s)) for s in split]

    def decode(self, ids: bytes) -> str:
        """The tokens' strings with a space between them, as the library gives them where a file has no decoder."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[str, BpeCodec] = {}


def codec(file: str) -> BpeCodec:
    if file not in _codecs:
        _codecs[file] = BpeCodec(file)
    return _codecs[file]


ENCODED = "n_tokens long, ids array<int>, decoded string"
DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"
DECODED_DIGEST = "n_tokens long, ids array<int>, decoded_sha256 string"


def _encoded(file: str, kind: str, remembered: int = REMEMBERED):
    from .common import release, text_lists

    # A batch of so many characters has about as many chunks as are remembered.
    chars = min(1 << 21, 7 * remembered)

    def run(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(file)
        names = [x.split()[0] for x in kind.split(", ")]
        hashed_ids, hashed_text = "ids_sha256" in names, "decoded_sha256" in names
        for col in cols:
            n, ids, decoded = [], [], []
            for texts in text_lists(col, chars, 4096):
                for raw in c.encode_batch(texts, remembered):
                    n.append(len(raw) // 4)
                    text = c.decode(raw)
                    ids.append(hashlib.sha256(raw).hexdigest() if hashed_ids else np.frombuffer(raw, "<i4"))
                    decoded.append(hashlib.sha256(text.encode()).hexdigest() if hashed_text else text)
            made = [pa.array(n, pa.int64()), pa.array(ids, pa.string() if hashed_ids else pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.StructArray.from_arrays(made, names)
        # A worker lives on after its task; what it remembers would take room from other stages.
        c.forget()
        release()

    return run


def encode(df: DataFrame, file: str, text: str = "text", digest: bool = False, decoded_digest: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Adds n_tokens, ids and decoded of each whole text; with digest, SHA-256 of ids and decoded instead; with
    decoded_digest, ids as they are and SHA-256 of decoded.

    Null and empty texts, and texts of white space alone, have no tokens and decode to an empty string. Every row
    is kept, repeated ones too; columns named as the new ones are replaced and all others pass through. An empty
    table gives an empty table. Special strings inside a text become their special ids. `remembered` trades a worker's
    memory for time; results don't depend on it.
    """
    from .common import modest_batches

    modest_batches(df)
    kind = DIGEST if digest else DECODED_DIGEST if decoded_digest else ENCODED
    made = F.arrow_udf(_encoded(file, kind, remembered), kind)(F.col(text).cast("string"))
    at = "__lode_encoded"
    names = [x.split()[0] for x in kind.split(", ")]
    return df.withColumn(at, made).withColumns({n: F.col(at)[n] for n in names}).drop(at)


def decode(df: DataFrame, file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the decoded text of a column of ids; null ids decode to null, no ids to an empty string. As in the library,
    an id that the vocabulary hasn't, a negative one among them, adds nothing, and neither does a null element. Every
    row is kept; a column named as `out` is replaced."""

    def run(col: pa.Array) -> pa.Array:
        known = codec(file).names
        return pa.array([None if x is None else " ".join(known[k] for k in x if k in known) for x in col.to_pylist()], pa.string())

    return df.withColumn(out, F.arrow_udf(run, "string")(F.col(ids)))


def op8(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), digest=True).drop("text")
