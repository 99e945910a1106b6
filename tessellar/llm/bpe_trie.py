"""BPE encoding by a depth-first walk over a trie of distinct words.

A byte pair encoding is decided from left to right by *last tokens*: the last token of a prefix is the one token t, ending
there, that is its own encoding and that may follow the last token of what stands before it (the pair encodes to itself).
The last token of a prefix depends on that prefix alone, so all words that share a prefix share it. Each block of distinct
words goes into a trie, the walk carries the last tokens of the path, and a shared prefix is worked out once. A branch that
holds one word ends in that word: its own letters need no nodes.

Null texts count as empty and give no token. Texts of any length are encoded whole; repeated rows give equal rows; an empty
table gives an empty result; columns other than the id and the text are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import still, table

END = "</w>"
#: White space as the tokenizer's patterns have it; U+001C to U+001F, which Python also counts, are not in it.
SPACE = "\t-\r \x85\xa0  -     　"
#: Distinct words in one trie, and entries kept between batches.
BLOCK, KEPT = 50_000, 300_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class TrieBPE:
    """Encoder for a vocabulary of merges with an end-of-word mark, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in self.vocab.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token.update((i, t) for t, i in self.special.items())
        self.parts = {a + b: (a, b) for a, b in reversed(pairs)}
        self.alphabet = byte_alphabet()
        self.pair_ok: dict[tuple[str, str], bool] = {}
        self.own: dict[str, bool] = {}
        self.by_end = self.candidates()

    @staticmethod
    def symbols(t: str) -> list[str]:
        return [*t[:-4][:-1], t[:-4][-1:] + END] if t.endswith(END) and len(t) > 4 else list(t)

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain merging by rank, for short strings."""
        s = symbols
        while len(s) > 1:
            best = min(range(len(s) - 1), key=lambda i: self.rank.get((s[i], s[i + 1]), 1 << 60))
            if (s[best], s[best + 1]) not in self.rank:
                break
            s = [*s[:best], s[best] + s[best + 1], *s[best + 2 :]]
        return s

    def is_own(self, t: str) -> bool:
        """Whether t encodes to itself."""
        ok = self.own.get(t)
        if ok is None:
            ok = self.own[t] = self.merge(self.symbols(t)) == [t]
        return ok

    def may_follow(self, a: str, b: str) -> bool:
        """Whether the symbols of a and b together encode to a, b.

        Follows, back in time, the right edge of a and the left edge of b: while edges x and y stand side by side, a merge
        of (x, y) would have come first if its rank is below that of x's next merge, or at most that of y's (of equal
        ranks the leftmost merge comes first).
        """
        rank, parts, never = self.rank, self.parts, 1 << 60
        till_a = till_b = never
        x, y = a, b
        while True:
            r = rank.get((x, y), never)
            if r < till_a and r <= till_b and r < never:
                return False
            px, py = parts.get(x), parts.get(y)
            if px is None and py is None:
                return True
            rx = -1 if px is None else rank[px]
            ry = -1 if py is None else rank[py]
            if rx > ry or rx == ry and px is not None and rx >= 0 and ry < 0:
                x, till_a = px[1], rx
            elif ry > rx:
                y, till_b = py[0], ry
            else:  # equal ranks: the one on the right was made last
                y, till_b = py[0], ry

    def candidates(self) -> tuple[tuple[dict[str, str], dict[str, tuple[int, ...]]], ...]:
        """Tokens that encode to themselves, without the end mark and with it: by their letters; and their lengths, longest first, by the last three letters (two, if they have but two)."""
        out = []
        for ended in (False, True):
            known, lengths = {}, {}
            for t in self.vocab:
                letters = t[:-4] if t.endswith(END) and len(t) > 4 else t
                if (letters is not t) == ended and len(letters) > 1 and t in self.parts and self.is_own(t):
                    known[letters] = t
                    lengths.setdefault(letters[-3:], set()).add(len(letters))
            for k, v in lengths.items():
                if len(k) == 3 and k[1:] in lengths:
                    v.add(2)
            out.append((known, {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}))
        return tuple(out)

    def encode_words(self, words: Iterable[str]) -> dict[str, list[str]]:
        """The tokens of each distinct non-empty word (normalised text), by block of words in order."""
        todo, out = sorted({w for w in words if w}), {}
        for at in range(0, len(todo), BLOCK):
            root: dict = {}
            if len(self.pair_ok) > 4 * KEPT:
                self.pair_ok.clear()
            for w in todo[at : at + BLOCK]:
                raw = w.encode()
                node, last = root, len(raw) - 1
                for i, b in enumerate(raw):
                    if i == last:
                        node[256 + b] = w
                        break
                    below = node.get(b)
                    if below is None:
                        node[b] = w
                        break
                    if type(below) is str:  # the branch held one word, which moves a letter down
                        other = below.encode()
                        node[b] = {other[i + 1] + 256 * (i + 2 == len(other)): below}
                        below = node[b]
                    node = below
            self._walk(root, out)
        return out

    def _walk(self, root: dict, out: dict[str, list[str]]) -> None:
        """lasts and sizes hold, for each prefix of the path, its last token and that token's number of symbols."""
        letters, pair_ok, may_follow = self.alphabet, self.pair_ok, self.may_follow
        (inner, inner_lengths), (final, final_lengths) = self.by_end
        prefix, lasts, sizes = "", [], []
        stack = [iter(root.items())]
        while stack:
            step = next(stack[-1], None)
            if step is None:
                stack.pop()
                if lasts:
                    lasts.pop()
                    sizes.pop()
                continue
            b, below = step
            depth = len(lasts)
            word = type(below) is str
            path = "".join([letters[x] for x in below.encode()]) if word else prefix[:depth] + letters[b]
            size = len(path)
            for n in range(depth + 1, size if word else size + 1):
                token, best = path[n - 1], 1
                for k in inner_lengths.get(path[n - 3 : n] if n > 2 else path[:n]) or inner_lengths.get(path[n - 2 : n] if n > 1 else path[:n], ()):
                    if k <= n and (t := inner.get(path[n - k : n])) is not None:
                        if k < n:
                            pair = (lasts[n - k - 1], t)
                            ok = pair_ok.get(pair)
                            if ok is None:
                                ok = pair_ok[pair] = may_follow(*pair)
                            if not ok:
                                continue
                        token, best = t, k
                        break
                lasts.append(token)
                sizes.append(best)
            if not word:
                prefix = path
                stack.append(iter(below.items()))
                continue
            token, best, n = path[-1] + END, 1, size  # the word's last symbol carries the mark
            for k in final_lengths.get(path[-3:]) or final_lengths.get(path[-2:], ()):
                if k <= n and (t := final.get(path[n - k :])) is not None:
                    if k < n:
                        pair = (lasts[n - k - 1], t)
                        ok = pair_ok.get(pair)
                        if ok is None:
                            ok = pair_ok[pair] = may_follow(*pair)
                        if not ok:
                            continue
                    token, best = t, k
                    break
            tokens = [token]
            while n := n - best:
                tokens.append(lasts[n - 1])
                best = sizes[n - 1]
            out[below] = tokens[::-1]
            del lasts[depth:], sizes[depth:]


class TextEncoder:
    """Encodes whole texts: splits off special tokens, normalises, cuts words, and keeps what chunks between spaces gave."""

    def __init__(self, path: str):
        import regex

        self.bpe = TrieBPE(path)
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.odd = regex.compile("[\x1c-\x1f]")
        self.cut = regex.compile(f"[{SPACE}]+")
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.bpe.special, key=len, reverse=True)))) if self.bpe.special else None
        self.numbers = {t: str(i) for t, i in self.bpe.vocab.items()}
        self.known: dict[str, tuple[str, str]] = {}

    @staticmethod
    def normal(chunk: str) -> str:
        if chunk.isascii():
            return chunk.lower()
        s = unicodedata.normalize("NFC", chunk)
        return "".join(map(str.lower, s)) if "Σ" in s else s.lower()

    def chunks(self, text: str) -> list[str]:
        return text.split() if self.odd.search(text) is None else [c for c in self.cut.split(text) if c]

    def learn(self, chunks: set[str]) -> None:
        """Puts the chunks' ids and tokens into memory, which holds at most 2 * KEPT chunks besides those of one call."""
        known = self.known
        if len(known) + len(chunks) > 2 * KEPT:
            known.clear()
        cut, find = {}, self.words.findall
        for c in chunks:
            if c.isascii() and c.isalpha():
                cut[c] = (c.lower(),)
            elif c.isascii() and c[:-1].isalpha() and c[-1] in ".,;:!?|":
                cut[c] = (c[:-1].lower(), c[-1])
            else:
                cut[c] = find(self.normal(c))
        # a word that was a chunk of its own before (not of several words, as the regular expression cuts it) is known
        words = {w for ws in cut.values() for w in ws}
        both = {w: known[w] for w in words.intersection(known) if w.isascii() and w.isalpha() or find(self.normal(w)) == [w]}
        number = self.numbers.__getitem__
        for w, ts in self.bpe.encode_words(words.difference(both)).items():
            both[w] = " ".join(map(number, ts)), " ".join(ts)
        for c, ws in cut.items():
            if len(ws) == 1:
                known[c] = both[ws[0]]
            elif len(ws) == 2:
                (i, t), (j, u) = both[ws[0]], both[ws[1]]
                known[c] = f"{i} {j}", f"{t} {u}"
            else:
                i, t = zip(*[both[w] for w in ws], strict=True)
                known[c] = " ".join(i), " ".join(t)

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text: number of tokens, ids and tokens, both joined by spaces."""
        parts: list[list[str]] = []
        for t in texts:
            if self.special is not None and "<|" in t and self.special.search(t):
                own, at = [], 0
                for m in self.special.finditer(t):
                    own += [*self.chunks(t[at : m.start()]), " " + m.group()]
                    at = m.end()
                parts.append(own + self.chunks(t[at:]))
            else:
                parts.append(self.chunks(t))
        known = self.known
        if fresh := set().union(*parts).difference(known):
            if len(known) + len(fresh) > 2 * KEPT:
                fresh = set().union(*parts)
            self.learn({c for c in fresh if c[0] != " "})
        known.update((" " + t, (str(i), t)) for t, i in self.bpe.special.items())  # no chunk of text starts with a space
        for p in parts:
            got = list(map(known.__getitem__, p))
            i = " ".join([g[0] for g in got])
            yield i.count(" ") + bool(i), i, " ".join([g[1] for g in got])


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str | None) -> TextEncoder:
    """One encoder for each Python worker."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """id_col, n_tokens, token_ids (array), decoded (the tokens joined by spaces, as a tokenizer without a decoder does)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for b in still(batches):
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                got = list(enc.encode([t or "" for t in part.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([[int(x) for x in g[1].split()] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got])], [id_col, "n_tokens", "token_ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, token_ids array<int>, decoded string")


def encode_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256: as encode_decode, with only digests leaving the Python workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        sha = hashlib.sha256
        for b in still(batches):
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                got = [(n, sha(i.encode()).hexdigest(), sha(d.encode()).hexdigest()) for n, i, d in enc.encode([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(table(spark, sf_dir, "documents"))
