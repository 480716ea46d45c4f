"""Problem 5: the language of a content and of each of its paragraphs.

A language is a unigram model over the pieces of a fixed public vocabulary. A word's probability is the sum over all its
segmentations, by the forward algorithm; a paragraph's is the product over its words. The piece probabilities are fitted
by expectation-maximisation on the word counts of the corpus. Paragraphs enter the counts under the language that their
function words name clearly, those without such words (headings, tables of data) under the language of their label, which is
right more often than not.

Words that all languages use alike are names, tools and towns: they say nothing and are left out, and so are addresses of
mail. Words with a capital that the counts do not know are left out where enough other words remain. Null and blank contents
have no language; repeated rows are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .p7_encode import TOKENIZERS

LANGS = ("it", "en", "es", "fr", "de")
#: Rounds of the fit.
ROUNDS = 3
#: Known words that a worker holds at most, the most frequent ones; the others come to the contents by a join.
HOT = 1_000_000
#: Words below which a content's label is not judged.
LEAST_WORDS = 8
#: Perplexity of the languages of a word from which it says nothing, and how often it must be seen for that.
COMMON, COMMON_LEAST = 3.2, 20
#: Entries that a task counts before it hands them on.
HELD = 400_000
#: Words remembered by a worker.
MEMORY = 400_000
#: Advantage in nats of a content's main language in a paragraph of it.
STAY = 1.5
WORD = re.compile(r"[^\W_]+")
MAIL = re.compile(r"(?<!\S)[^\s@]*\s?(?:@|[(\[]\s?(?:at|chiocciola)\s?[)\]])\s?\S+", re.I)
AT_SIGNS = re.compile(r"@|[(\[]\s?(?:at|chiocciola)\s?[)\]]", re.I)
# Function words that name a language.
FUNCTION_WORDS = {
    "it": "il lo gli di del della dei delle che per con nel nella sul sulla una sono è ha ho anche più dal al alla questo presso dove usando".split(),
    "en": "the and of to in for with on from was were is are they he she by at as an which also more than this i have".split(),
    "es": "el los las del y con para por una que en su fue se más desde hasta donde también lo como al sobre".split(),
    "fr": "le les des du et pour avec une dans sur aux est était qui par plus chez elle où son je d l puis".split(),
    "de": "der die das und mit für von den im bei nach ein eine auf zu war wurde er sie dem des am auch als ich".split(),
}
# Names and codes of the languages as labels write them.
LABELS = {
    "it": "it ita italian italiano italiana italien italienisch ital".split(),
    "en": "en eng english inglese ingles inglés anglais englisch".split(),
    "es": "es spa esp spanish spagnolo spagnola español espanol castellano espagnol spanisch".split(),
    "fr": "fr fra fre french francese français francais francés frances französisch franzosisch".split(),
    "de": "de deu ger german tedesco tedesca deutsch aleman alemán allemand".split(),
}
BY_LABEL = {name: lang for lang, names in LABELS.items() for name in names}
SEEDS = {w: [k for k, lang in enumerate(LANGS) if w in FUNCTION_WORDS[lang]] for names in FUNCTION_WORDS.values() for w in names}


def label_language(label: str | None) -> str | None:
    """Language a label names in any notation, or None."""
    text = (label or "").strip().casefold()
    return BY_LABEL.get(text) or BY_LABEL.get(re.split(r"[-_ (/]", text)[0])


def without_mail(text: str) -> str:
    return MAIL.sub(" ", text) if AT_SIGNS.search(text) else text


def paragraphs(text: str | None) -> list[str]:
    return [p for p in re.split(r"\n[ \t\r]*\n", text) if p.strip()] if text else []


def seed_language(words: list[str]) -> int | None:
    """Index of the language named by clearly more function words than any other."""
    votes = [0.0] * len(LANGS)
    for w in words:
        for k in SEEDS.get(w, ()):
            votes[k] += 1 / len(SEEDS[w])
    best = max(range(len(LANGS)), key=votes.__getitem__)
    rest = max(v for k, v in enumerate(votes) if k != best)
    return best if votes[best] >= 3 and votes[best] >= 2 * rest + 1 else None


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, n over all paragraphs (t, and l: the label if there is one); counted in each task first.

    A paragraph counts under the language that its function words name, else under that of the label.
    """
    labelled = "l" in texts.columns

    def count(batches):
        total = [Counter() for _ in LANGS]

        def rows():
            for k, c in enumerate(total):
                yield pd.DataFrame([(LANGS[k], w, n) for w, n in c.items()], columns=["lang", "word", "n"])
                c.clear()

        for part in batches:
            for text, label in zip(part["t"], part["l"] if labelled else [None] * len(part)):
                own = label_language(label)
                for p in paragraphs(text):
                    found = WORD.findall(without_mail(p.lower()))
                    k = seed_language(found)
                    k = LANGS.index(own) if k is None and own else k
                    if k is not None:
                        total[k].update(found)
            if sum(map(len, total)) > HELD:
                yield from rows()
        yield from rows()

    return texts.mapInPandas(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


@lru_cache(maxsize=2)
def vocabulary(folder: str) -> dict[str, int]:
    """Pieces of the public vocabulary that a lower-case word can hold."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
    names = [sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))]
    return {p: k for k, p in enumerate(n for n in names if n == n.lower())}


@lru_cache(maxsize=8)
def longest_piece(folder: str) -> int:
    return max(map(len, vocabulary(folder)))


def trie(pieces: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps of the trie of the pieces as sorted keys (node, character), the node each leads to, and the piece of a node or -1."""
    step, piece = {}, [-1]
    for name, k in pieces.items():
        at = 0
        for c in name:
            key = at << 21 | ord(c)
            at = step.setdefault(key, len(piece))
            if at == len(piece):
                piece.append(-1)
        piece[at] = k
    keys = np.array(sorted(step), np.int64)
    return keys, np.array([step[k] for k in keys.tolist()], np.int64), np.array(piece, np.int64)


@lru_cache(maxsize=2)
def vocabulary_trie(folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return trie(vocabulary(folder))


def spans(word: str, pieces: dict[str, int], longest: int | None = None) -> tuple[int, list[tuple[int, int, int]]]:
    """Length of the marked word and its pieces as (start, end, piece); -1 stands for a character outside the vocabulary."""
    text = "▁" + word
    n = len(text)
    longest = longest or max(map(len, pieces), default=1)
    found = []
    for i in range(n):
        any_one = False
        for j in range(i + 1, min(n, i + longest) + 1):
            k = pieces.get(text[i:j])
            if k is not None:
                found.append((i, j, k))
                any_one |= j == i + 1
        if not any_one:
            found.append((i, i + 1, -1))
    return n, found


FLOOR = 1e-7


def forward(n: int, found, p: np.ndarray) -> np.ndarray:
    """Probability of each language for every end of a prefix; the last row is the word's."""
    alpha = np.zeros((n + 1, p.shape[1]))
    alpha[0] = 1
    for i, j, k in found:  # sorted by start, so alpha[i] is complete
        alpha[j] += alpha[i] * (p[k] if k >= 0 else FLOOR)
    return alpha


def log_forward(n: int, found, p: np.ndarray) -> np.ndarray:
    """Logarithm of the word's probability in each language; in logarithms all the way, for words of any length."""
    logs = np.log(p)
    alpha = np.full((n + 1, p.shape[1]), -np.inf)
    alpha[0] = 0
    for i, j, k in found:
        alpha[j] = np.logaddexp(alpha[j], alpha[i] + (logs[k] if k >= 0 else math.log(FLOOR)))
    return alpha[n]


class Lattice:
    """The segmentations of many words at once: spans grouped by their place, each group one step of the forward algorithm."""

    def __init__(self, words: list[str], pieces: dict[str, int], steps: tuple | None = None):
        keys, to, piece = steps or trie(pieces)
        texts = ["▁" + w for w in words]
        self.ends = np.array([len(t) for t in texts], int)
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), self.ends)
        last = np.cumsum(self.ends)[owner]
        start = at = np.arange(len(code))
        node, found = np.zeros(len(code), np.int64), []
        while len(at):  # all starts go down the trie together, as long as it has their next character
            key = node << 21 | code[at]
            where = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            ok = keys[where] == key
            k = np.where(ok, piece[to[where]], -1)
            keep = k >= 0 if found else np.full(len(k), True)  # a character outside the vocabulary is a span too
            found.append((start[keep], at[keep] + 1, k[keep]))
            ok &= at + 1 < last[start]
            start, at, node = start[ok], at[ok] + 1, to[where[ok]]
        i, j, self.k = map(np.concatenate, zip(*found)) if found else np.zeros((3, 0), int)
        self.w = owner[i]
        first = (np.cumsum(self.ends) - self.ends)[self.w]
        self.i, self.j = i - first, j - first
        place = self.i * (self.ends.max(initial=0) + 1) + self.j
        order = np.argsort(place, kind="stable")
        self.i, self.j, self.w, self.k, place = (x[order] for x in (self.i, self.j, self.w, self.k, place))
        self.groups = np.split(np.arange(len(place)), np.flatnonzero(np.diff(place)) + 1) if len(place) else []

    def values(self, p: np.ndarray) -> np.ndarray:
        return np.where(self.k[:, None] >= 0, p[self.k], FLOOR)

    def forward(self, p: np.ndarray) -> np.ndarray:
        alpha, v = np.zeros((len(self.ends), self.ends.max(initial=0) + 1, p.shape[1])), self.values(p)
        alpha[:, 0] = 1
        for g in self.groups:
            alpha[self.w[g], self.j[g]] += alpha[self.w[g], self.i[g]] * v[g]
        return alpha

    def expected(self, p: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected uses of pieces, given the counts of the words by language: pieces, languages, uses, one entry a span."""
        pieces, langs, uses = [], [], []
        for lang in range(p.shape[1]):
            column = p[:, lang]
            some = counts[:, lang] > 0  # most words are of one language
            value, w = np.where(self.k >= 0, column[self.k], FLOOR), self.w
            live = some[w]
            alpha = np.zeros((self.ends.max(initial=0) + 1, len(self.ends)))
            beta = np.zeros_like(alpha)
            alpha[0], beta[self.ends, np.arange(len(self.ends))] = 1, 1
            groups = [x for x in (g[live[g]] for g in self.groups) if len(x)]
            for g in groups:
                alpha[self.j[g[0]], w[g]] += alpha[self.i[g[0]], w[g]] * value[g]
            for g in reversed(groups):
                beta[self.i[g[0]], w[g]] += beta[self.j[g[0]], w[g]] * value[g]
            scale = counts[:, lang] / np.maximum(alpha[self.ends, np.arange(len(self.ends))], 1e-300)
            x = np.flatnonzero(live & (self.k >= 0))
            pieces.append(self.k[x])
            langs.append(np.full(len(x), lang))
            uses.append(scale[w[x]] * alpha[self.i[x], w[x]] * value[x] * beta[self.j[x], w[x]])
        return tuple(map(np.concatenate, (pieces, langs, uses)))

    def first(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Uses of pieces before the first round: by the square of their length."""
        known = np.flatnonzero(self.k >= 0)
        share = (self.j - self.i)[known] ** 2 / (self.ends[self.w[known]] - 1)
        x, lang = np.nonzero(counts[self.w[known]])
        return self.k[known][x], lang, counts[self.w[known][x], lang] * share[x]


def long_expected(word: str, pieces: dict[str, int], p: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lattice.expected of one word in logarithms, for words of any length."""
    n, found = spans(word, pieces)
    langs = np.flatnonzero(counts)
    logs, floor = np.log(p[:, langs]), math.log(FLOOR)
    alpha, beta = np.full((n + 1, len(langs)), -np.inf), np.full((n + 1, len(langs)), -np.inf)
    alpha[0] = beta[n] = 0
    for i, j, k in found:
        alpha[j] = np.logaddexp(alpha[j], alpha[i] + (logs[k] if k >= 0 else floor))
    for i, j, k in reversed(found):
        beta[i] = np.logaddexp(beta[i], beta[j] + (logs[k] if k >= 0 else floor))
    i, j, k = np.array([x for x in found if x[2] >= 0], int).reshape(-1, 3).T
    uses = np.exp(alpha[i] + logs[k] + beta[j] - alpha[n]) * counts[langs]
    return np.repeat(k, len(langs)), np.tile(langs, len(k)), uses.ravel()


def uses(words: list[str], counts: np.ndarray, p: np.ndarray | None, pieces: dict[str, int], steps: tuple, scale: float) -> np.ndarray:
    """Uses of each piece in each language, for the start (p is None) or a round of the fit, in whole numbers of 1 / scale.

    Whole numbers add up to the same in any order, so the model does not depend on the split of the words.
    """
    total = np.zeros(len(pieces) * len(LANGS), np.int64)

    def add(k, lang, got):
        np.add.at(total, k * len(LANGS) + lang, np.rint(got * scale).astype(np.int64))

    small = [x for x, w in enumerate(words) if p is None or len(w) < PLAIN]
    lattice = Lattice([words[x] for x in small], pieces, steps)
    add(*(lattice.first(counts[small]) if p is None else lattice.expected(p, counts[small])))
    for x in set(range(len(words))).difference(small):
        add(*long_expected(words[x], pieces, p, counts[x]))
    return total.reshape(-1, len(LANGS))


def unit(longest_word: int) -> float:
    """Scale at which the uses of a piece stay whole numbers of 64 bits, for words that weigh WEIGHT in each language."""
    return 2.0 ** math.floor(62 - math.log2(WEIGHT * max(256, longest_word + 1)))


def estimate(step, size: int) -> np.ndarray:
    """Piece probabilities of each language by EM; step gives the uses of the pieces under given probabilities."""
    p = 1e-3 + step(None)
    p /= p.sum(axis=0)
    for _ in range(ROUNDS):
        got = step(p)
        got /= np.maximum(got.sum(axis=0), 1e-9)
        p = 0.97 * got + 0.02 * got.mean(axis=1, keepdims=True) + 0.01 / size
    return p


def fit(counts: dict[str, np.ndarray], pieces: dict[str, int]) -> np.ndarray:
    """Piece probabilities of each language by EM on word counts (word to counts by language)."""
    words, number, steps = list(counts), np.array(list(counts.values()), float).reshape(-1, len(LANGS)), trie(pieces)
    number, scale = number * (WEIGHT / np.maximum(number.sum(axis=0), 1)), unit(max(map(len, words), default=0))
    return estimate(lambda p: uses(words, number, p, pieces, steps, scale) / scale, len(pieces))


def fit_table(words: DataFrame, folder: str) -> np.ndarray:
    """fit over a table (word, n: counts by language). Each round is a pass over it that brings home one number a piece and language."""
    context, size = words.sparkSession.sparkContext, len(vocabulary(folder))
    sums = [F.sum(F.col("n")[k]).alias(lang) for k, lang in enumerate(LANGS)]
    *totals, longest = words.agg(*sums, F.max(F.length("word"))).first()
    weight, scale = WEIGHT / np.maximum(np.array([t or 0 for t in totals], float), 1), unit(longest or 0)

    def step(p):
        model = context.broadcast(p)

        def run(batches):
            pieces, steps = vocabulary(folder), vocabulary_trie(folder)
            total = np.zeros((size, len(LANGS)), np.int64)
            for part in batches:
                if len(part):
                    total += uses(part["word"].tolist(), np.stack(part["n"]) * weight, model.value, pieces, steps, scale)
            x = np.flatnonzero(total)
            yield pd.DataFrame({"x": x, "n": total.ravel()[x]})

        got = words.mapInPandas(run, "x bigint, n bigint").groupBy("x").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(size * len(LANGS))
        total[got["x"].to_numpy()] = got["n"].to_numpy()
        return total.reshape(size, len(LANGS)) / scale

    return estimate(step, size)


#: Letters from which a word's probability is summed in logarithms.
PLAIN = 32
#: Weight of all words of a language in the fit: languages weigh alike.
WEIGHT = 1e6


def word_scores(w: str, p: np.ndarray, pieces: dict[str, int], longest: int) -> tuple:
    n, found = spans(w, pieces, longest)
    return tuple((np.log(np.maximum(forward(n, found, p)[n], 1e-300)) if n <= PLAIN else log_forward(n, found, p)).tolist())


def bounded(scores: np.ndarray, size) -> np.ndarray:
    """Advantages of the languages in a word. A single word cannot outweigh the rest: they are bounded, in a run of letters by its length."""
    return np.maximum(scores - scores.max(axis=-1, keepdims=True), np.minimum(-6.0, np.asarray(size) / -3.0)[..., None])


def advantages(words: list[str], p: np.ndarray, folder: str) -> np.ndarray:
    """bounded of many words, a row each."""
    pieces, longest, out = vocabulary(folder), longest_piece(folder), np.zeros((len(words), len(LANGS)))
    size = np.array([len(w) for w in words], int)
    small, every = np.flatnonzero(size < PLAIN), range(0, len(words), 10_000)
    for x in (small[k : k + 10_000] for k in every if k < len(small)):
        lattice = Lattice([words[k] for k in x], pieces, vocabulary_trie(folder))
        out[x] = np.log(np.maximum(lattice.forward(p)[np.arange(len(x)), lattice.ends], 1e-300))
    for x in np.flatnonzero(size >= PLAIN):
        out[x] = word_scores(words[x], p, pieces, longest)
    return bounded(out, size)


class Model:
    """known: rows of the known words that are held, -1 for a word that all languages use alike; rows: advantages of the languages."""

    def __init__(self, p: np.ndarray, known: dict[str, int], rows: np.ndarray, folder: str):
        self.p, self.known, self.folder, self.pieces, self.longest = p, known, folder, vocabulary(folder), longest_piece(folder)
        self.memory: dict[str, int] = {}
        self.held = self.size = len(rows)
        self.rows = np.concatenate([rows, np.zeros((1024, len(LANGS)))])

    def learn(self, words: list[str], rows: np.ndarray | None = None) -> None:
        """Adds words to the memory."""
        rows = advantages(words, self.p, self.folder) if rows is None else rows
        end = self.size + len(words)
        if end > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(end, 2 * self.size) - self.size, len(LANGS)))])
        self.rows[self.size : end] = rows
        self.memory.update(zip(words, range(self.size, end)))
        self.size = end

    def forget(self) -> None:
        """Clears a full memory; only between contents, as a content holds numbers of rows."""
        if len(self.memory) > MEMORY:
            self.memory.clear()
            self.size = self.held

    def word(self, w: str) -> int:
        got = self.memory.get(w)
        if got is None:
            self.learn([w], bounded(np.array(word_scores(w, self.p, self.pieces, self.longest)), len(w)))
            got = self.memory[w]
        return got

    def paragraph(self, text: str) -> tuple[int, np.ndarray]:
        """Number of words, and the log-likelihood of each language."""
        written = WORD.findall(text)
        n, shown = len(written), without_mail(text)
        known, others, memory, rows = self.known, [], self.memory, []
        for x in written if shown is text else WORD.findall(shown):
            w = x.lower()
            got = known.get(w)
            if got is None:
                if not (w.isalpha() and len(w) > 1):
                    continue
                if x[0] != w[0]:
                    others.append(w)
                    continue
                got = memory.get(w)
                got = self.word(w) if got is None else got
            if got >= 0:
                rows.append(got)
        if len(rows) < 4:
            rows += [self.word(w) for w in others]
        return n, self.rows[rows].sum(axis=0) if rows else np.zeros(len(LANGS))

    def content(self, text: str | None, more: dict[str, bool] | None = None) -> list[tuple[int, str, float, int]]:
        """(seg_no, lang, confidence, words): 0 for the whole, then each paragraph if they are not all in one language.

        more: known words of this text that the model does not hold, and whether all languages use them alike.
        """
        self.forget()
        if more:
            self.known.update({w: -1 if alike else self.word(w) for w, alike in more.items()})
        parts = [self.paragraph(p) for p in paragraphs(text)]
        for w in more or ():
            del self.known[w]
        if not parts:
            return []
        total = sum(s for _, s in parts)
        if not sum(n for n, _ in parts) or not total.any():
            return []
        main = int(np.argmax(total))
        found = []
        for n, s in parts:
            s = s.copy()
            s[main] += STAY
            k = int(np.argmax(s))
            found.append((k, 1 / np.exp(np.minimum(s - s[k], 0)).sum(), n))
        share = Counter()
        for k, _, n in found:
            share[k] += n
        most = max(share, key=lambda k: (share[k], total[k]))
        sure = float(np.average([c if k == most else 1 - c for k, c, n in found], weights=[n + 1e-9 for *_, n in found]))
        out = [(0, LANGS[most], sure, sum(n for *_, n in found))]
        if len(share) > 1 and len({k for k, _, _ in found}) > 1:
            out += [(i + 1, LANGS[k], float(c), n) for i, (k, c, n) in enumerate(found)]
        return out


def known_words(texts: DataFrame) -> DataFrame:
    """word, n (its counts by language, all words seen more than twice in a language), alike (all languages use it alike)."""
    counts = common.saved(word_counts(texts).where("n > 2"), "language-words")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # five
    size = np.array([max(1, totals.get(lang, 0)) for lang in LANGS], float)
    if not totals:
        rows = [(w, [10 * (w in FUNCTION_WORDS[lang]) for lang in LANGS], False) for w in SEEDS]
        return texts.sparkSession.createDataFrame(rows, "word string, n array<bigint>, alike boolean")

    def judge(batches):
        for part in batches:
            n = np.stack(part["n"]) if len(part) else np.zeros((0, len(LANGS)))
            alike = (n.sum(axis=1) >= COMMON_LEAST) & common_to_all(n / size) & ~part["word"].isin(SEEDS).to_numpy()
            yield part.assign(alike=alike)

    each = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)) for lang in LANGS]
    words = counts.groupBy("word").agg(F.array(*each).alias("n"))
    return common.saved(words.mapInPandas(judge, "word string, n array<bigint>, alike boolean"), "language-known")


def fitted(texts: DataFrame, folder: str = TOKENIZERS):
    """What trained gives, and a table of the other known words or None."""
    words = known_words(texts)
    p = fit_table(words.where("not alike"), folder)
    words = words.select("word", "alike", F.aggregate("n", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n"))
    held, rest, hot = 0, None, words
    for r in words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect():  # numbers of times, not words
        if held + r.words > HOT:
            hot, rest = words.where(F.col("n") > r.n), words.where(F.col("n") <= r.n).select("word", "alike")
            break
        held += r.words
    model = texts.sparkSession.sparkContext.broadcast(p)

    def score(batches):
        for part in batches:
            yield part.assign(a=list(advantages(part["word"].tolist(), model.value, folder)))

    got = hot.select("word", "alike").mapInPandas(score, "word string, alike boolean, a array<double>").toArrow()
    known = {w: -1 if alike else k for k, (w, alike) in enumerate(zip(got["word"].to_pylist(), got["alike"].to_pylist()))}
    return (p, known, got["a"].combine_chunks().flatten().to_numpy().reshape(-1, len(LANGS))), rest


def trained(texts: DataFrame, folder: str = TOKENIZERS):
    """Piece probabilities, numbers of the HOT most frequent known words and their advantages, as a Model takes them.

    texts has the columns t and, if there are labels, l.
    """
    return fitted(texts, folder)[0]


def common_to_all(share: np.ndarray) -> np.ndarray:
    """Whether a word is spread over the languages, by the perplexity of its shares (the last axis)."""
    share = share / share.sum(axis=-1, keepdims=True)
    return np.exp(-(share * np.log(np.maximum(share, 1e-12))).sum(axis=-1)) > COMMON


def with_rest(rows: DataFrame, known: dict, rest: DataFrame) -> DataFrame:
    """rows (t and others) with more: the words of t that are in rest, after - if all languages use them alike, else after +.

    Joined by word and by the hash of the text.
    """
    held = rows.sparkSession.sparkContext.broadcast(frozenset(known))

    def others(batches):
        hot = held.value
        for part in batches:
            met = [list({w.lower() for p in paragraphs(t) for w in WORD.findall(without_mail(p))} - hot) for t in part["t"]]
            yield pd.DataFrame({"h": part["h"], "words": met})

    rows = rows.withColumn("h", F.unhex(F.sha2("t", 256)))
    met = rows.select("h", "t").where("t is not null").mapInPandas(others, "h binary, words array<string>")
    met = met.select("h", F.explode("words").alias("word")).join(rest, "word")
    more = met.groupBy("h").agg(F.collect_set(F.concat(F.when(F.col("alike"), "-").otherwise("+"), "word")).alias("more"))
    return rows.join(more, "h", "left").drop("h")


def languages(hits: DataFrame, key: str = "hit_id", text: str = "content", label: str | None = "language", folder: str = TOKENIZERS) -> DataFrame:
    """key, seg_no, lang, confidence, words, label_lang (language the label names, null if none)."""
    columns = [F.col(key).alias("k"), F.col(text).alias("t"), (F.col(label) if label else F.lit(None).cast("string")).alias("l")]
    rows = common.spread(hits.select(*columns))
    held, rest = fitted(rows.select("t", "l"), folder)
    model = hits.sparkSession.sparkContext.broadcast(held)
    if rest is not None:
        rows = with_rest(rows, held[1], rest)

    def run(batches):
        m = Model(*model.value, folder)
        for part in batches:
            more = [x if x is None else {w[1:]: w[0] == "-" for w in x} for x in part["more"]] if "more" in part else [None] * len(part)
            m.forget()
            m.learn(list({w for x in more if x for w, alike in x.items() if not alike}.difference(m.memory)))
            out = [(k, *seg, label_language(lab)) for k, t, lab, x in zip(part.k, part.t, part.l, more) for seg in m.content(t, x)]
            yield pd.DataFrame(out, columns=["k", "seg_no", "lang", "confidence", "words", "label_lang"])

    kind = hits.select(key).dtypes[0][1]
    return rows.mapInPandas(run, f"k {kind}, seg_no int, lang string, confidence double, words int, label_lang string").withColumnRenamed("k", key)


def p5_language(spark, sf_dir: str) -> DataFrame:
    """Language and confidence of every content (seg_no 0) and of each paragraph of a mixed one."""
    return languages(common.table(spark, sf_dir, "hits"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    rows = languages(common.table(spark, sf_dir, "hits"))
    wrong = F.col("label_lang").isNull() | (F.col("label_lang") != F.col("lang"))
    return rows.where((F.col("seg_no") > 0) | ((F.col("words") >= LEAST_WORDS) & wrong)).select("hit_id", "seg_no", "lang")
