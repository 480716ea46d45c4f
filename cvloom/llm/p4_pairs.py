"""Problem 4: question and answer pairs that are broken, with the kind of defect.

Languages of question and answer are compared by posteriors of a naive Bayes model over the character n-grams of words. An
answer breaks off where its last characters, of all places where they occur in the corpus, seldom end a line or a text.
A refusal is a sentence that a naive Bayes model over words and pairs of words takes for one; seed forms of refusals label
the sentences it learns from, so that other wordings made of the same words are found too. Empty answers and returned
questions are told by their form. The order of the kinds decides where several hold: empty_answer, copied_question, refusal,
other_language, truncated_answer.

A null query can be neither copied nor of another language. Null, blank and wordless answers are empty. Repeated rows are
judged each, also under one key.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .p5_language import LANGS, WORD, seed_language

#: Lengths of the character contexts at the end of a text, and how often one must occur to be trusted.
CONTEXTS, TRUSTED = (14, 10, 6), 12
#: Shares of a context's occurrences below which an end there is a break.
LINE_SHARE, TEXT_SHARE, START_SHARE = 0.12, 0.03, 0.02
#: Characters of the n-grams of a language, entries of the model, and the posterior that both sides must reach.
GRAMS, MODEL_SIZE, SURE = (1, 2, 3, 4), 40_000, 0.95
START = 14
#: Words and pairs of words in the model of refusals, and the log-odds that a sentence must reach.
REFUSAL_MODEL, REFUSAL_ODDS = 20_000, 12.0
#: Entries that a task counts before it hands them on.
HELD = 400_000
# Answers that stand for nothing.
FILLERS = frozenset("null none nil nan n/a na nd n.d. undefined empty vuoto leer vacío vide ok".split())
# Labels before a returned question.
ASKED = re.compile(r"^(?:query|q|question|domanda|richiesta|frage|anfrage|pregunta|consulta|demande|requete|user|utente)\s*[.:)\-]\s*")
ASKED_BARE = re.compile(r"^(?:query|q|question|domanda|richiesta|frage|anfrage|pregunta|consulta|demande|requete|user|utente) (?=\w)")
PAUSE = re.compile(r"[.!?\"”»*]*\s*(?:\n+|(?<=[.!?])\s+)")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
LETTERS = re.compile(r"[^\W\d_]+")
# Cores of sentences that decline a task, without accents; the seeds of the model of refusals.
REFUSALS = [
    # Italian
    r"non (?:sono|siamo) in grado di (?:fornire|aiutar|rispondere|assister|dare|soddisfare|elaborare|condividere)", r"non posso (?:proprio )?(?:aiutar|fornire|rispondere|assister|dare informazioni|condividere|soddisfare|procedere|elaborare)", r"non mi e (?:permesso|consentito|possibile)", r"devo declinare", r"oltre cio che mi e (?:permesso|consentito)", r"non rientra tra (?:le attivita|i (?:miei )?compiti|le mie)", r"non mi sento a mio agio", r"preferisco non (?:rispondere|esprimermi|parlarne)", r"non mi occupo di", r"non sono autorizzat",
    # English
    r"\b(?:am|m|are) (?:unable|not able|not allowed|not permitted|not authori[sz]ed) to (?:provide|help|answer|assist|discuss|share|give|comply|process)", r"(?:can ?t|cannot|can not|won ?t|will not) (?:help|assist|provide|answer|comply|share|discuss|process|fulfil)", r"must decline", r"beyond what i am allowed", r"not among the things i", r"(?:do not|don ?t) feel comfortable", r"(?:would|d) rather not", r"(?:do not|don ?t) take part in", r"told not to", r"not something i can help",
    # Spanish
    r"no puedo (?:ayudar|proporcionar|responder|facilitar|dar informacion|compartir|atender|asistir)", r"no me esta permitido", r"prefiero no (?:responder|contestar|hablar)", r"no entra en lo que puedo", r"(?:debo|tengo que) (?:declinar|rechazar)", r"no participo en", r"no estoy autorizad", r"no me siento comod",
    # French
    r"je prefere ne pas", r"ne m est pas permis", r"ne fait pas partie de mes", r"je ne (?:peux|puis) (?:malheureusement )?pas (?:vous )?(?:aider|repondre|fournir|donner|partager|communiquer)", r"je ne participe pas", r"je dois (?:decliner|refuser)", r"je ne suis pas (?:autorise|en mesure de (?:fournir|repondre|vous aider))", r"je ne me sens pas a l aise",
    # German
    r"darf ich (?:leider )?keine", r"gehort nicht zu meinen aufgaben", r"mochte ich lieber nicht", r"kann ich (?:ihnen |dir )?(?:leider )?nicht (?:helfen|weiterhelfen|antworten|beantworten)", r"beteilige ich mich nicht", r"muss ich (?:leider )?ablehnen", r"bin (?:leider )?nicht (?:in der lage|befugt|berechtigt)", r"fuhle mich nicht wohl",
]
REFUSAL = re.compile("|".join(REFUSALS))
HIDDEN = re.compile("[​-‏⁠﻿­]")


def bare(text: str) -> str:
    """Lower case, no accents, words and digits only."""
    text = unicodedata.normalize("NFKD", HIDDEN.sub("", text).casefold())
    return " ".join(re.findall(r"[^\W_]+", "".join(c for c in text if not unicodedata.combining(c))))


def empty(text: str | None) -> bool:
    """Whether an answer says nothing: no words, a filler, or headings over empty list items."""
    if text is None:
        return True
    text = HIDDEN.sub("", text).strip()
    if not re.search(r"[^\W_]", text) or text.strip("`*_\"'()[]{}<>.,:;!?- \n").casefold() in FILLERS:
        return True
    lines = [x.strip(" *_#`>") for x in text.splitlines() if x.strip(" *_#`>")]
    items = [x for x in lines if re.fullmatch(r"(?:[-•*]|\d+[.)])?", x)]
    return bool(items) and all(x in items or x.endswith(":") for x in lines)


def close(a: str, b: str) -> bool:
    """Whether two texts are the same but for a few letters."""
    if a == b:
        return True
    if not a or not b or abs(len(a) - len(b)) > max(2, 0.08 * len(b)):
        return False
    return edits(a, b) <= max(2, int(0.08 * len(b)))


def edits(a: str, b: str) -> int:
    """Levenshtein distance; a column of its table is held as the bits of two numbers (Myers 1999, Hyyro 2003)."""
    if not a or not b:
        return len(a) + len(b)
    every, last, where = (1 << len(a)) - 1, 1 << (len(a) - 1), {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score = every, 0, len(a)
    for c in b:
        same = where.get(c, 0)
        x = same | down
        y = (((same & up) + up) ^ up) | same
        more, less = down | (~(y | up) & every), up & y
        score += 1 if more & last else -1 if less & last else 0
        more, less = (more << 1 | 1) & every, less << 1 & every
        up, down = less | (~(x | more) & every), more & x
    return score


def without_question(query: str | None, response: str) -> str | None:
    """The response after a leading copy of the query; None if nothing else is there."""
    q = bare(query or "")
    if not q:
        return response
    text, most = response, 1.08 * len(q) + 24
    while True:  # every turn cuts a copy off
        lead = text.lstrip(" \n\"'“”«»>*#")
        r = bare(text)
        if ASKED.match(unicodedata.normalize("NFKD", lead.casefold())):
            r = ASKED_BARE.sub("", r)
        if not r or close(r, q):
            return None
        cut = None
        for m in PAUSE.finditer(lead):
            head = bare(lead[: m.end()])
            if len(head) > most:
                break
            if close(head, q) or close(ASKED_BARE.sub("", head), q):
                cut = m.end()
                break
        if cut is None:
            return text
        text = lead[cut:]


def sentences(text: str) -> list[str]:
    return [x for x in (bare(p) for p in SENTENCE.split(text)) if x]


def word_features(sentence: str) -> list[str]:
    """Words and pairs of neighbours of a sentence, each once."""
    w = ["<", *sentence.split(), ">"]
    return [*{*w[1:-1], *map(" ".join, zip(w, w[1:]))}]


class Held:
    """Counts of a task, handed on when they grow large, so that its memory does not grow with its input."""

    def __init__(self, width: int):
        self.counts: dict = {}
        self.width = width

    def add(self, key, at: int, n: int = 1) -> None:
        got = self.counts.get(key)
        if got is None:
            got = self.counts[key] = [0] * self.width
        got[at] += n

    def rows(self, least: int = HELD):
        if len(self.counts) >= least:
            out = [(*(k if isinstance(k, tuple) else (k,)), *v) for k, v in self.counts.items()]
            self.counts.clear()
            for at in range(0, len(out), 100_000):
                yield out[at : at + 100_000]


def refusal_counts(rows: DataFrame) -> DataFrame:
    """feature, yes, no: in how many sentences of seed refusals and of other answers each word and pair stands."""

    def count(batches):
        held = Held(2)
        names = ["feature", "yes", "no"]
        for part in batches:
            for r in part.response:
                said = sentences(r) if r else []
                marks = [bool(REFUSAL.search(x)) for x in said]
                for x, y in zip(said, marks):
                    if y or not any(marks):
                        held.add("", 0 if y else 1)
                        for f in word_features(x):
                            held.add(f, 0 if y else 1)
            for out in held.rows():
                yield pd.DataFrame(out, columns=names)
        for out in held.rows(1):
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(count, "feature string, yes bigint, no bigint").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))


class Refusals:
    """Naive Bayes over words and pairs of words of a sentence."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        counts = {f: (y, n) for f, y, n in rows}
        self.yes, self.no = counts.pop("", (0, 0))
        size = len(counts) + 1
        self.odds = {f: math.log((y + 0.5) / (self.yes + 0.5 * size)) - math.log((n + 0.5) / (self.no + 0.5 * size)) for f, (y, n) in counts.items()}
        self.base = math.log((self.yes + 0.5) / (self.no + 0.5))

    def holds(self, text: str) -> bool:
        """Whether a sentence of the text is a seed form, or words that the model takes for a refusal."""
        said = sentences(text)
        if any(map(REFUSAL.search, said)):
            return True
        return self.yes >= TRUSTED and any(self.base + sum(self.odds.get(f, 0.0) for f in word_features(x)) > REFUSAL_ODDS for x in said)


def units(text: str) -> list[str]:
    """Words of a text and the joints between them: the ends of two neighbours around a blank. Together they hold each n-gram once."""
    found = LETTERS.findall(text.lower())
    return found + [f" {a}"[-2:] + " " + f"{b} "[:2] for a, b in zip(found, found[1:])]


def grams(unit: str) -> list[str]:
    """Character n-grams of a word between blanks, or those that reach over a joint."""
    if " " in unit:
        return [unit[1:4], unit[:4], unit[1:]]
    w = f" {unit} "
    return [w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1 - (n == 1))]


def gram_counts(rows: DataFrame) -> DataFrame:
    """gram and its count in each language, from the pairs whose answer names its language clearly; the question counts under it too.

    Words and joints are counted first, and their grams take the counts.
    """

    def count(batches):
        held = Held(len(LANGS))
        names = ["unit", *LANGS]
        for part in batches:
            for q, r in zip(part["query"], part.response):
                k = seed_language(WORD.findall((r or "").lower()))
                if k is not None:
                    for u in units(r) + units(q or ""):
                        held.add(u, k)
            for out in held.rows():
                yield pd.DataFrame(out, columns=names)
        for out in held.rows(1):
            yield pd.DataFrame(out, columns=names)

    def cut(batches):
        for part in batches:
            out = [(g, *n) for u, *n in part.itertuples(index=False) for g in grams(u)]
            yield pd.DataFrame(out, columns=["gram", *LANGS])

    total = [F.sum(c).alias(c) for c in LANGS]
    kinds = ", ".join(f"{c} bigint" for c in LANGS)
    return rows.mapInPandas(count, f"unit string, {kinds}").groupBy("unit").agg(*total).mapInPandas(cut, f"gram string, {kinds}").groupBy("gram").agg(*total)


class Languages:
    """Naive Bayes over character n-grams; the likelihoods of words and joints are remembered."""

    def __init__(self, rows: list[tuple]):
        counts = np.array([r[1:] for r in rows], float).reshape(len(rows), len(LANGS))
        total = counts.sum(axis=0)
        # Languages without any text cannot win.
        self.absent = total == 0
        self.at = {r[0]: k for k, r in enumerate(rows)}
        self.p = np.log((counts + 0.5) / (total + 0.5 * MODEL_SIZE))
        self.memory: dict[str, np.ndarray | None] = {}

    def unit(self, w: str):
        found = [k for g in grams(w) if (k := self.at.get(g)) is not None]
        if len(self.memory) > HELD:
            self.memory.clear()
        got = self.memory[w] = self.p[found].sum(axis=0) if found else None
        return got

    def posterior(self, text: str) -> np.ndarray:
        memory = self.memory
        found = [x for w in units(text) if (x := memory[w] if w in memory else self.unit(w)) is not None]
        # Overlapping grams repeat their evidence: it is weighed by the number of orders.
        score = np.where(self.absent, -np.inf, np.sum(found, axis=0) / len(GRAMS)) if found else np.zeros(len(LANGS))
        e = np.exp(score - score.max())
        return e / e.sum()


def plain(text: str) -> str:
    """Text as its end contexts are counted."""
    return re.sub(r"\d", "9", re.sub(r"[*_`#]", "", text.rstrip(" \t*_`")))


def context_counts(rows: DataFrame) -> DataFrame:
    """context, occurrences, at line ends, at text ends; and contexts of starts, with how many texts are one paragraph."""

    def count(batches):
        seen, lines, ends, starts, short = (Counter() for _ in range(5))

        def rows():
            for c in [seen, starts]:
                keys = [*c]
                for at in range(0, len(keys), 100_000):
                    yield pd.DataFrame([(k, c[k], lines[k] if c is seen else short[k], ends[k]) for k in keys[at : at + 100_000]], columns=["context", "n", "line", "end"])
            for c in [seen, lines, ends, starts, short]:
                c.clear()

        for part in batches:
            for r in part.response:
                if r is None or not r.strip():
                    continue
                if len(seen) > HELD:
                    yield from rows()
                text = plain(r)
                head = "^" + text[:START]
                starts[head] += 1
                short[head] += "\n" not in text.strip()
                split = ["\n" + m.rstrip() for m in text.split("\n")]
                for n in CONTEXTS:
                    # A context does not reach over the start of its line.
                    for m in split:
                        if len(m) > n:
                            seen.update([m[i : i + n] for i in range(len(m) - n + 1)])
                            lines[m[-n:]] += 1
                        elif len(m) > 1:
                            seen[m] += 1
                            lines[m] += 1
                    ends[split[-1][-n:]] += 1
        yield from rows()

    counted = rows.mapInPandas(count, "context string, n bigint, line bigint, end bigint")
    return counted.groupBy("context").agg(F.sum("n").alias("n"), F.sum("line").alias("line"), F.sum("end").alias("end"))


def own_contexts(text: str) -> list[str]:
    text = plain(text)
    last = "\n" + text.split("\n")[-1].rstrip()
    return [*dict.fromkeys(last[-n:] for n in CONTEXTS), "^" + text[:START]]


def breaks_off(text: str, counts: dict[str, tuple[int, int, int]]) -> bool:
    """Whether the end is an unlikely one, by the longest context that is seen often enough."""
    shown = plain(text)
    *ends, start = own_contexts(text)
    n, single, _ = counts.get(start, (0, 0, 0))
    if n >= 3 * TRUSTED and "\n" not in shown.strip() and single < START_SHARE * n + 1:
        return True
    for context in ends:
        n, line, end = counts.get(context, (0, 0, 0))
        if n >= TRUSTED:
            if line < LINE_SHARE * n:
                return True
            if context[-1] in ":,;(" or shown.rstrip()[-1] in ":,;(":
                return end < TEXT_SHARE * n + 1
            return False
    return shown.rstrip()[-1:] not in ".!?…)\"”»" and not re.match(r"\s*(?:[-•*]|\d+[.)])\s", shown.split("\n")[-1])


def judged(rows: DataFrame, key: str = "eval_id") -> DataFrame:
    """key, defect (null if none), query_lang, response_lang of every pair."""
    spark = rows.sparkSession
    kind = rows.select(key).dtypes[0][1]
    rows = common.spread(rows.select(F.col(key).alias("k"), "query", "response")).withColumn("row", F.monotonically_increasing_id())
    rows = common.saved(rows, "pairs")
    total = common.saved(gram_counts(rows), "grams")
    top = total.orderBy(F.desc(sum(F.col(c) for c in LANGS)), "gram").limit(MODEL_SIZE).collect()
    declines = refusal_counts(rows).orderBy((F.col("feature") != "").cast("int"), F.desc("yes"), F.desc("no"), "feature").limit(REFUSAL_MODEL + 1).collect()
    model = spark.sparkContext.broadcast(([tuple(r) for r in top], [tuple(r) for r in declines]))  # bounded by MODEL_SIZE and REFUSAL_MODEL
    contexts = context_counts(rows)

    @F.pandas_udf("array<string>")
    def get(texts: pd.Series) -> pd.Series:
        return texts.map(own_contexts)

    own = rows.where(F.trim("response") != "").select("row", F.explode(get("response")).alias("context")).join(contexts, "context")
    own = own.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("context", F.array("n", "line", "end")))).alias("contexts"))  # four a pair

    def run(batches):
        nb, no = Languages(model.value[0]), Refusals(model.value[1])
        for part in batches:
            out = []
            for k, q, r, c in zip(part.k, part["query"], part.response, part.contexts):
                out.append((k, *defect(q, r, {x: tuple(v) for x, v in dict(c).items()} if c is not None else {}, nb, no)))
            yield pd.DataFrame(out, columns=["k", "defect", "query_lang", "response_lang"])

    joined = rows.join(own, "row", "left").select("k", "query", "response", "contexts")
    return joined.mapInPandas(run, f"k {kind}, defect string, query_lang string, response_lang string").withColumnRenamed("k", key)


def defect(query: str | None, response: str | None, counts: dict, nb: Languages, no: Refusals) -> tuple[str | None, str | None, str | None]:
    if empty(response):
        return "empty_answer", None, None
    rest = without_question(query, response)
    if rest is None or empty(rest):
        return "copied_question", None, None
    if no.holds(rest):
        return "refusal", None, None
    pq, pr = nb.posterior(query or ""), nb.posterior(rest)
    lq, lr = LANGS[int(pq.argmax())], LANGS[int(pr.argmax())]
    if query and lq != lr and pq.max() >= SURE and pr.max() >= SURE:
        return "other_language", lq, lr
    return ("truncated_answer" if breaks_off(response, counts) else None), lq, lr


def p4_found(spark, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "evaluations")
    return judged(rows).where("defect is not null").select("eval_id", "defect")
