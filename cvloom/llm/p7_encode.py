"""Problem 7: the ids of every text by a public byte-level BPE tokenizer.

A minimal acyclic automaton holds the frequent words of the corpus. It is built once on the driver from counts over all
texts, written to the shared folder (or brought to every executor from there) and memory-mapped by every worker. A word's number is the sum of the skips on its
path, and the number leads to its ids. Words that are not in it are merged exactly.

Null and empty texts give the empty list. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import mmap
import struct
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Folder of the tokenizer files; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: Words in the automaton at most. It bounds what the driver collects and what a worker maps.
LEXICON_WORDS = 32_768
#: Words a worker remembers before it forgets them all.
MEMORY = 400_000
#: Fixed value: the pattern by which the public vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT = regex.compile(PATTERN)
SIGNS = frozenset(".,:;)!?/-")
#: First character beyond those of which every Unicode version says the same.
WESTERN = "\u0250"
#: Bytes by which a word that cannot be in the automaton is told without a walk.
HEAD = 5
#: A space between other white space, where a word of the pattern may hold several of them.
BETWEEN = regex.compile(r"\s (?:\s|$)")


@lru_cache(maxsize=4)
def merger(folder: str, name: str = "byte_bpe_50k.tiktoken"):
    """Function from the bytes of one word to its ids by exact merges."""
    import tiktoken

    with open(f"{folder}/{name}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def merge(word: bytes) -> list[int]:
        own = ranks.get(word)
        return [own] if own is not None else encoding._encode_single_piece(word)

    return merge


def build(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal automaton of the words as one block of bytes.

    Words are added in order. When the next word leaves a branch, the branch's states are replaced from its end by equal
    states already known, so that suffixes are shared.
    """
    order = sorted(entries)
    known: dict[tuple, int] = {}
    made: list[tuple[bool, tuple]] = []

    def settle(final: bool, arcs: list) -> int:
        key = (final, tuple(arcs))
        if key not in known:
            known[key] = len(made)
            made.append(key)
        return known[key]

    open_states: list[list] = [[False, []]]
    labels: list[int] = []

    def close(depth: int) -> None:
        while len(labels) > depth:
            final, arcs = open_states.pop()
            open_states[-1][1].append((labels.pop(), settle(final, arcs)))

    last = b""
    for word in order:
        shared = 0
        while shared < min(len(last), len(word)) and last[shared] == word[shared]:
            shared += 1
        close(shared)
        for b in word[shared:]:
            labels.append(b)
            open_states.append([False, []])
        open_states[-1][0] = True
        last = word
    close(0)
    root = settle(*open_states[0])

    below = [0] * len(made)
    for s, (final, arcs) in enumerate(made):  # targets are made before their sources
        below[s] = final + sum(below[t] for _, t in arcs)
    first, label, target, skip, finals = [0], bytearray(), [], [], bytearray()
    for final, arcs in made:
        at = int(final)
        for b, t in arcs:
            label.append(b)
            target.append(t)
            skip.append(at)
            at += below[t]
        first.append(len(label))
        finals.append(final)
    ids = [entries[w] for w in order]
    starts = np.cumsum([0, *map(len, ids)], dtype="<i4")
    numbers = [np.array(x, "<i4").tobytes() for x in (first, target, skip)] + [starts.tobytes(), np.array([*chain(*ids)], "<i4").tobytes()]
    blocks = [*numbers, bytes(label), bytes(finals)]
    return struct.pack("<9q", root, len(order), *map(len, blocks)) + b"".join(blocks)


BYTES = [bytes([b]) for b in range(256)]


class Lexicon:
    """A mapped automaton."""

    def __init__(self, block):
        self.block = block
        root, self.size, *lengths = struct.unpack_from("<9q", block, 0)
        self.root = root
        view, at, parts = memoryview(block), struct.calcsize("<9q"), []
        for k, n in enumerate(lengths):
            parts.append(view[at : at + n].cast("i") if k < 5 else (at, n))
            at += n
        self.first, self.target, self.skip, self.starts, self.ids = parts[:5]
        self.labels, self.finals = parts[5][0], parts[6][0]
        self.look = block.find

    def find(self, word: bytes) -> list[int] | None:
        s, number, base = self.root, 0, self.labels
        look, first, skip, target = self.look, self.first, self.skip, self.target
        for b in word:
            arc = look(BYTES[b], base + first[s], base + first[s + 1]) - base
            if arc < 0:
                return None
            number += skip[arc]
            s = target[arc]
        if not self.block[self.finals + s]:
            return None
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist()


    def heads(self, n: int) -> frozenset[bytes]:
        """First n bytes of all words, and all shorter words."""
        out, stack = set(), [(self.root, b"")]
        while stack:
            s, head = stack.pop()
            if len(head) == n:
                out.add(head)
                continue
            if self.block[self.finals + s]:
                out.add(head)
            for arc in range(self.first[s], self.first[s + 1]):
                stack.append((self.target[arc], head + BYTES[self.block[self.labels + arc]]))
        return frozenset(out)


def open_lexicon(path: str) -> Lexicon:
    with open(path, "rb") as f:
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def split_part(part: str) -> list[str]:
    """Words of a part. Western letters alone, with or without one sign after them, need no pattern."""
    body = part[1:] if part[:1] == " " else part
    if body and max(body) < WESTERN:
        if body.isalpha():
            return [part]
        if body[-1] in SIGNS and body[:-1].isalpha():
            return [part[:-1], part[-1]]
    return SPLIT.findall(part)


class Parts(dict):
    """Remembers what is worked out for a part of a text; forgets everything when it holds too many."""

    def __init__(self, work):
        super().__init__()
        self.work = work

    def __missing__(self, part: str):
        if len(self) > MEMORY:
            self.clear()
        got = self[part] = self.work(part)
        return got


def pieces_of(text: str) -> list[str]:
    """Parts of a text whose words can be found one part at a time.

    A space after or before something else than white space starts a word of the public pattern, so a text is cut before
    each. A text with a space amid white space is one part.
    """
    if BETWEEN.search(text):
        return [text]
    first, *rest = text.split(" ")
    return [first, *[" " + r for r in rest]]


def encoder(lexicon: Lexicon, merge):
    """Function from a text to its ids."""

    find, heads = lexicon.find, lexicon.heads(HEAD)

    def ids_of(word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass")
        found = find(data) if data[:HEAD] in heads else None
        return merge(data) if found is None else found

    words = Parts(ids_of)
    known = words.__getitem__

    def ids_of_part(part: str) -> list[int]:
        own = split_part(part)
        return known(own[0]) if len(own) == 1 else [*chain.from_iterable(map(known, own))]

    parts = Parts(ids_of_part)

    def encode(text: str | None) -> list[int]:
        if not text:
            return []
        pieces = pieces_of(text)
        if len(pieces) == 1:
            return parts.work(text)
        return [*chain.from_iterable(map(parts.__getitem__, pieces))]

    return encode


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of all words of all texts.

    Parts between spaces are counted in each partition and summed; each part's words then take its count.
    """

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value:
                    total.update(pieces_of(value))
        parts = [*total]
        for at in range(0, len(parts), 50_000):
            some = parts[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([total[w] for w in some], pa.int64())], ["part", "n"])

    counted = common.spread(docs.select(text).where(F.length(text) > 0)).mapInArrow(count, "part string, n bigint")
    parts = counted.groupBy("part").agg(F.sum("n").alias("n"))
    words = parts.select(F.explode(F.regexp_extract_all("part", F.lit(PATTERN), F.lit(0))).alias("word"), "n")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def lexicon_block(docs: DataFrame, folder: str = TOKENIZERS, text: str = "text", size: int = LEXICON_WORDS) -> bytes:
    """The automaton of the most frequent words; how many the driver takes is bounded by size.

    A histogram of the counts gives the least count that keeps the words within the bound, so no partition sends its own
    best words to the driver.
    """
    counts = common.saved(word_counts(docs, text).where("n > 1"), "word-counts")
    step = F.floor(F.log2("n") * 8).cast("int")
    least, kept = None, 0
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        if kept + r["count"] > size:
            break
        least, kept = r.step, kept + r["count"]
    merge = merger(folder)
    frequent = counts.where(step >= least).collect() if kept else []
    return build({(w := r.word.encode()): merge(w) for r in frequent})


def prepared(docs: DataFrame, folder: str = TOKENIZERS, text: str = "text", fetch: bool | None = None):
    """Function without arguments, for workers: it gives the encoder."""
    block = lexicon_block(docs, folder, text)
    path = common.shared_file(docs.sparkSession, block, "lexicon", fetch)
    return lambda: encoder(open_lexicon(path()), merger(folder))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, fetch: bool | None = None) -> DataFrame:
    """key and ids of every row; null and empty texts give the empty list, repeated rows are kept."""
    make = prepared(docs, folder, text, fetch)

    def run(batches):
        encode_text = make()
        for batch in batches:
            ids = [encode_text(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, "int32")
            np.cumsum([*map(len, ids)], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(ids), "int32", int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["k", "ids"])

    kind = docs.select(key).dtypes[0][1]
    return common.spread(docs.select(key, text)).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def with_lengths(docs: DataFrame, text: str = "text", folder: str = TOKENIZERS, name: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each text, the text itself left out.

    Numbers need no lexicon: each word is merged once per worker and its length remembered.
    """
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest).withColumn(name, F.lit(0)).schema

    def run(batches):
        merge = merger(folder)
        words = Parts(lambda w: len(merge(w.encode("utf-8", "surrogatepass"))))
        parts = Parts(lambda part: sum(map(words.__getitem__, split_part(part))))
        for batch in batches:
            numbers = [sum(map(parts.__getitem__, pieces_of(t))) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(numbers, pa.int32())], [*rest, name])

    return common.spread(docs.select(text, *rest)).mapInArrow(run, schema)


def p7_ids(spark, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"))
