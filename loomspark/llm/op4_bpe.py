"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes tokens for every word not seen before; the proposals of a batch
are verified together: a sequence is what merging would give exactly when each token encodes to
itself and each adjacent pair survives being merged side by side. The pair test undoes merges
from the latest to the earliest and asks at each step whether a merge across the border would
have come first; it runs over all pairs at once in NumPy. Only words with a failing pair are
merged one step at a time. Normalisation is the tokenizer file's own.

Edge cases: a null or empty text has no ids and decodes to the empty string; special token
strings in a text become their ids, as the library does; repeated rows give equal rows; words
of any length are encoded whole; other columns of the input are carried through, but for those
named ``ids`` and ``decoded``, which the result replaces.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words, and characters of them, in a generation of the cache between batches; its size costs time only.
CACHE_WORDS, CACHE_CHARACTERS = 250_000, 8 << 20
CACHE_PAIRS = 1_000_000
#: Words up to so many bytes are merged on a plain list.
SHORT_WORD = 40

# Characters that normalisation only lower-cases, and on which the pre-tokenizer's classes can be spelled out.
_PLAIN = re.compile("[\t\n\r -~À-ÿ]*")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t\n\r a-zß-öø-ÿ0-9]+")
_NONE = np.iinfo(np.int64).max


def _byte_characters() -> list[str]:
    """Byte-level BPE's printable character for each byte: itself where printable, else the next free one from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in printable else spare))
        spare += b not in printable
    return out


class SpeculativeBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocab: dict[str, int] = model["vocab"]
        self.size = max(self.vocab.values()) + 1
        self.names = [""] * self.size
        for name, i in self.vocab.items():
            self.names[i] = name
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.rank = np.full(self.size, -1, dtype=np.int64)
        self.left = np.zeros(self.size, dtype=np.int64)
        self.right = np.zeros(self.size, dtype=np.int64)
        self.merges: dict[int, int] = {}
        self.made: list[int] = []
        self.ambiguous: set[int] = set()
        for k, (a, b) in enumerate(model["merges"]):
            ia, ib, ic = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.made.append(ic)
            if ia * self.size + ib in self.merges:
                continue
            self.merges[ia * self.size + ib] = k
            if self.rank[ic] >= 0:
                self.ambiguous.add(ic)  # two derivations: left to exact merging
            else:
                self.rank[ic], self.left[ic], self.right[ic] = k, ia, ib
        codes = np.fromiter(self.merges, dtype=np.int64)
        ranks = np.fromiter(self.merges.values(), dtype=np.int64)
        order = np.argsort(codes)
        self.codes, self.code_ranks = codes[order], ranks[order]
        self.longest = max(len(n.removesuffix(self.suffix)) for n in self.vocab)
        self.characters = _byte_characters()
        self.judged: set[int] = set()
        self.sound: set[int] = set()
        self.known_pairs: set[int] = set()
        self.good_pairs: set[int] = set()
        self.failed = self.words = 0
        self.caches: dict[bool, tuple[dict, dict]] = {True: ({}, {}), False: ({}, {})}
        self.cached = {True: 0, False: 0}

    def merge(self, word: str) -> list[int]:
        """Exact merging of one word of byte characters: lowest rank first, leftmost among equals."""
        ids = [self.vocab[p] for p in word[:-1] if p in self.vocab]
        if (last := word[-1] + self.suffix) in self.vocab:
            ids.append(self.vocab[last])
        return self.merge_ids(ids) if len(ids) <= SHORT_WORD else self.merge_long(ids)

    def merge_ids(self, ids: list[int]) -> list[int]:
        """For short words: a list of the ranks of neighbours, of which the least is merged each time."""
        get, size, new = self.merges.get, self.size, self.made
        ranks = [get(a * size + b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            ids[i] = new[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] * size + ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = get(ids[i] * size + ids[i + 1], _NONE)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """For long words: a heap of merges over a linked list, n log n."""
        size, get = self.size, self.merges.get
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := get(a * size + b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.made[rank], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := get(ids[x] * size + ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def greedy(self, word: str) -> list[int] | None:
        """Longest match from the left; None where some place has no token."""
        out, at, n, vocab = [], 0, len(word), self.vocab
        while at < n:
            end = min(n, at + self.longest)
            while end > at:
                token = vocab.get(word[at:] + self.suffix if end == n else word[at:end])
                if token is not None:
                    break
                end -= 1
            else:
                return None
            out.append(token)
            at = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: would merging leave the border between them alone?"""
        good = np.zeros(len(a), dtype=bool)
        at, limit = np.arange(len(a)), np.full(len(a), _NONE)
        while len(at):
            code = a * self.size + b
            k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            across = np.where(self.codes[k] == code, self.code_ranks[k], _NONE)
            ra, rb = self.rank[a], self.rank[b]
            fine = (across >= limit) | (across == _NONE)
            done = fine & (ra < 0) & (rb < 0)
            good[at[done]] = True
            go = fine & ~done
            a, b, at, ra, rb = a[go], b[go], at[go], ra[go], rb[go]
            undo = ra > rb
            limit = np.where(undo, ra, rb + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return good

    def _judge(self, tokens: set[int]) -> None:
        """Which tokens encode to themselves; one without the suffix is merged as the inside of a word."""
        for token in tokens - self.judged:
            name = self.names[token]
            if name.endswith(self.suffix):
                alone = self.merge(name.removesuffix(self.suffix))
            else:
                alone = self.merge_ids([self.vocab[c] for c in name])
            if alone == [token] and token not in self.ambiguous:
                self.sound.add(token)
            self.judged.add(token)

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of distinct words of byte characters: proposed greedily, verified together, merged where that fails."""
        size, good = self.size, self.good_pairs
        proposed = [self.greedy(w) or () for w in words]
        self._judge({t for p in proposed for t in p})
        checks = [[x * size + y for x, y in zip(p, p[1:])] for p in proposed]
        if new := {c for codes in checks for c in codes} - self.known_pairs:
            codes = np.fromiter(new, dtype=np.int64)
            good.update(codes[self.compatible(codes // size, codes % size)].tolist())
            self.known_pairs |= new
        out = []
        for word, p, codes in zip(words, proposed, checks):
            if p and self.sound.issuperset(p) and good.issuperset(codes):
                out.append(tuple(p))
            else:
                self.failed += 1
                out.append(tuple(self.merge(word)))
        self.words += len(words)
        if len(self.known_pairs) > CACHE_PAIRS:
            self.known_pairs, self.good_pairs = set(), set()
        return out

    def _known(self, words: list[str], plain: bool) -> dict[str, tuple[int, ...]]:
        """A cache of two generations: what the older one still serves moves to the newer one."""
        old, cache = self.caches[plain]
        if missing := set(words).difference(cache):
            if len(cache) + len(missing) > CACHE_WORDS or self.cached[plain] > CACHE_CHARACTERS:
                old, cache = self.caches[plain] = (cache, {})
                self.cached[plain] = 0
                missing = set(words)
            self.cached[plain] += sum(map(len, missing))
            if again := [w for w in missing if w in old]:
                cache.update((w, old[w]) for w in again)
                missing.difference_update(again)
            new = list(missing)
            mapped = ["".join([self.characters[x] for x in w.encode()]) for w in new] if plain else new
            cache.update(zip(new, self.encode_words(mapped)))
        return cache

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.special_split.split(text):
            if part in self.special:
                out.append(self.special[part])
                continue
            if plain := _PLAIN.fullmatch(part) is not None:
                words = _WORDS.findall(part.lower())
            else:
                normal = self.library.normalizer.normalize_str(part)
                words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
            known = self._known(words, plain)
            for w in words:
                out += known[w]
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library decodes a file that names no decoder: token strings joined by one space."""
        names = self.names
        return " ".join([names[i] for i in ids])


@lru_cache(maxsize=2)
def load(path: str) -> SpeculativeBpe:
    bpe = SpeculativeBpe(path)
    for name, i in bpe.special.items():
        if i >= len(bpe.names):
            bpe.names += [""] * (i + 1 - len(bpe.names))
        bpe.names[i] = name
    return bpe


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``ids`` (array of int) and ``decoded`` (string) in place of the text column of a table."""
    path = path or default_path()
    columns = [c for c in df.columns if c not in (text, "ids", "decoded")]

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.encode(t or "") for t in part.column(text).to_pylist()]
                flat = np.fromiter((i for x in ids for i in x), dtype=np.int32)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([bpe.decode(x) for x in ids], pa.string())],
                    [*columns, "ids", "decoded"],
                )

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "ids array<int>", "decoded string"])
    return df.select(*columns, text).mapInArrow(run, schema)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_decode(docs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
