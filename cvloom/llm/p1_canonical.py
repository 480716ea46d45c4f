"""Problem 1: freely typed roles, towns and skills mapped to the entries of a reference list.

A symmetric-delete dictionary of the entries is broadcast. A typed value is cleaned of its surroundings and looked up whole
within a bounded edit distance; then word by word, in any order and with short forms written out, each word within its own
bound. Candidates are ranked by weighted Damerau-Levenshtein distance, then by how often the entry is written exactly in the
table. A value without a candidate is reported with -1. Each distinct value is worked out once per worker and remembered. A
list beyond one dictionary is looked up in several, one after another, with the same result.

Null values give no row; blank values mean no entry; repeated rows are kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Entries in one broadcast dictionary; a longer list is looked up in several, one after another.
BLOCK = 20_000
#: Leading characters from which deletes are taken.
PREFIX = 9
#: Values a worker remembers.
MEMORY = 500_000

# Words around a value that do not change its meaning, by field.
AROUND = {
    "role": ["senior", "sr", "sr.", "junior", "jr", "jr.", "mid", "middle", "lead", "principal", "staff", "freelance", "consulente", "stage", "stagista", "intern", "trainee", "contractor", "part time", "full time", "partita iva", "p.iva", "tempo determinato", "tempo indeterminato", "interim", "esperto", "expert", "m/f", "f/m", "w/m", "m/w/d"],
    "location": ["zona", "vicino a", "vicino", "presso", "provincia di", "provincia", "prov.", "prov", "pr. di", "area", "area di", "hinterland", "hinterland di", "comune di", "citta di", "citta", "near", "bei", "cerca de", "pres de", "province of", "e dintorni", "dintorni di", "dintorni", "e provincia", "centro", "centre", "nord", "sud", "est", "ovest", "ibrido", "hybrid", "in sede", "eu", "ue", "italia", "italy", "italien", "italie", "germania", "germany", "deutschland", "francia", "france", "spagna", "spain", "espana", "svizzera", "switzerland", "schweiz", "austria", "osterreich", "portogallo", "portugal", "regno unito", "uk", "irlanda", "ireland", "belgio", "belgium", "olanda", "paesi bassi", "netherlands", "polonia", "poland", "repubblica ceca", "grecia", "greece", "area metropolitana", "metropolitana"],
    "skill": ["conoscenza", "conoscenza di", "conoscenze", "conoscenze di", "base", "basic", "basico", "intermedio", "intermediate", "medio", "avanzato", "avanzata", "advanced", "esperto", "expert", "ottimo", "ottima", "buono", "buona", "livello", "level", "livello base", "livello avanzato", "versione", "version", "v"],
}
# Widely known other names that the list may lack; a parameter of found(), {} for none.
OTHER = {
    "role": {"fullstack engineer": "Full Stack Developer", "full stack engineer": "Full Stack Developer", "fullstack developer": "Full Stack Developer", "devops specialist": "DevOps Engineer", "ui/ux designer": "UX Designer", "dba": "Database Administrator", "sysadmin": "System Administrator", "pm": "Project Manager", "roboticista": "Robotics Engineer", "roboticist": "Robotics Engineer"},
    "location": {
        "mailand": "Milano", "florenz": "Firenze", "genua": "Genova", "mi": "Milano", "rm": "Roma", "to": "Torino", "na": "Napoli", "bo": "Bologna", "fi": "Firenze", "ge": "Genova", "ve": "Venezia", "pa": "Palermo", "ct": "Catania", "ba": "Bari", "pd": "Padova", "vr": "Verona", "ts": "Trieste", "bs": "Brescia", "bg": "Bergamo", "mo": "Modena", "pr": "Parma", "pg": "Perugia", "an": "Ancona", "ca": "Cagliari", "rc": "Reggio Calabria", "re": "Reggio Emilia", "vv": "Vibo Valentia", "aq": "L'Aquila", "fc": "Forlì", "sa": "Salerno", "pe": "Pescara", "cs": "Cosenza", "tn": "Trento", "bz": "Bolzano", "ud": "Udine", "li": "Livorno", "gr": "Grosseto",
        "full remote": "Remoto", "da remoto": "Remoto", "remoto": "Remoto", "telelavoro": "Remoto", "smart working": "Remoto", "home office": "Remoto", "da casa": "Remoto", "homeoffice": "Remoto", "teletrabajo": "Remoto", "teletravail": "Remoto",
    },
    "skill": {"react.js": "react", "react js": "react", "angular.js": "angular", "c sharp": "c#", "c plus plus": "c++", "go": "golang", "postgre": "postgresql", "next js": "next.js", "vue js": "vue.js", "node js": "node.js"},
}
# What stands for "nothing given".
FILLER = re.compile(r"^(?:n\s*[./]?\s*[ad]\.?|tbd|none|null|nd|[-_.?*/x\s]*)$")
# Usual short forms.
SHORT = {"mgr": ["manager"], "dev": ["developer"], "eng": ["engineer"], "svil": ["sviluppatore"], "arch": ["architect", "architetto"], "anl": ["analyst"], "cons": ["consultant", "consulente"], "admin": ["administrator"], "spec": ["specialist"]}
# Neighbours on the keyboard.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
NEAR = {frozenset(p) for row in ROWS for p in zip(row, row[1:])}


def plain(text: str) -> str:
    """Lower case without accents, odd forms of letters and repeated white space."""
    text = unicodedata.normalize("NFKD", text.casefold().replace("ß", "ss").replace("’", "'"))
    return re.sub(r"\s+", " ", "".join(c for c in text if not unicodedata.combining(c))).strip()


def loose(text: str) -> str:
    """plain() with word separators as spaces."""
    return re.sub(r"\s+", " ", re.sub(r"[-_/,;|']+|(?<=\w)\.(?= |$)", " ", plain(text))).strip(" .")


def most(n: int) -> int:
    """Edits allowed for a key of n characters."""
    return 0 if n <= 3 else 1 if n <= 7 else 2


def in_word(n: int) -> int:
    """Edits allowed in a word of n characters, as far as its key allows them."""
    return 1 if n <= 3 else 2


def deletes(text: str, edits: int) -> set[str]:
    head = text[:PREFIX]
    return {"".join(c for k, c in enumerate(head) if k not in gone) for d in range(edits + 1) for gone in map(set, combinations(range(len(head)), min(d, len(head))))}


def distance(a: str, b: str) -> tuple[int, float]:
    """Damerau-Levenshtein distance, swaps of letters that edits brought together included, and its weighted form.

    Doubled letters, neighbours on the keyboard and spaces weigh less; a change of the first letter weighs more.
    """
    n, m = len(a), len(b)
    rows = [[(j, float(j)) for j in range(m + 1)]]
    where: dict[str, int] = {}
    for i in range(1, n + 1):
        row, x, at = [(i, float(i))], a[i - 1], 0
        for j in range(1, m + 1):
            y, head = b[j - 1], 0.25 * (i == 1 or j == 1)
            u, w = rows[i - 1][j - 1]
            best = (u, w) if x == y else (u + 1, w + head + (0.8 if frozenset((x, y)) in NEAR else 1))
            u, w = rows[i - 1][j]
            best = min(best, (u + 1, w + head + (0.6 if x == " " or (i > 1 and a[i - 2] == x) else 0.9)))
            u, w = row[j - 1]
            best = min(best, (u + 1, w + head + (0.6 if y == " " or (j > 1 and b[j - 2] == y) else 0.95)))
            k = where.get(y, 0)
            if k and at:
                u, w = rows[k - 1][at - 1]
                between = (i - k - 1) + (j - at - 1)
                best = min(best, (u + 1 + between, w + head + 0.7 + between))
            if x == y:
                at = j
            row.append(best)
        where[x] = i
        rows.append(row)
    return rows[n][m]


class Dictionary:
    """Entries of one field with their deletes; counts: how often an entry is written exactly."""

    def __init__(self, field: str, entries: list[tuple[int, str, list[str]]], counts: dict[int, int], other: dict[str, str] | None = None):
        self.field, self.counts, self.by_key = field, counts, {}
        values = {plain(v): i for i, v, _ in entries}

        def add(form: str, i: int) -> None:
            """Of entries with the same form the one written more often holds it."""
            if form:
                old = self.by_key.get(form)
                if old is None or (-counts.get(i, 0), i) < (-counts.get(old, 0), old):
                    self.by_key[form] = i

        for i, value, aliases in entries:
            for name in [value, *[a for a in aliases or [] if a]]:
                for form in (plain(name), loose(name), loose(name).replace(" ", "")):
                    add(form, i)
        for name, value in (OTHER.get(field, {}) if other is None else other).items():
            if plain(value) in values:
                for form in {plain(name), loose(name)} - self.by_key.keys():
                    add(form, values[plain(value)])
        self.index = defaultdict(set)
        for key in self.by_key:
            for d in deletes(key, most(len(key))):
                self.index[d].add(key)
        # Keys of several words by their words, the words by their deletes, and all leading parts of keys without blanks.
        self.with_word, self.near_word, self.sizes, self.leading = defaultdict(set), defaultdict(set), set(), set()
        for key in self.by_key:
            words = key.split()
            self.sizes.add(len(words))
            if len(words) > 1:
                for t in words:
                    self.with_word[t].add(key)
            else:
                self.leading.update(key[:n] for n in range(1, len(key) + 1))
        for t in self.with_word:
            for d in deletes(t, in_word(len(t))):
                self.near_word[d].add(t)
        around = sorted({form for w in AROUND.get(field, []) for form in (plain(w), loose(w))}, key=len, reverse=True)
        some = "|".join(map(re.escape, around))
        self.lead, self.tail = re.compile(rf"^(?:{some})(?=[\s(,:.-]|$)[\s,:.-]*"), re.compile(rf"[\s,:.-]*(?<![\w])(?:{some})$")

    def cores(self, text: str) -> list[str]:
        """The text as it is, then without what stands around the value."""
        found = [text]
        inner = re.sub(r"\s*\([^)]*\)\s*$", "", text).strip()
        if inner != text:
            found.append(inner or text.strip("() "))
        text = inner or text.strip("() ")
        if self.field == "skill":
            text = re.sub(r"\s+v?\d+(?:\.\d+)*(?:\.x)?$", "", text)
        before = None
        end = text
        while (shorter := self.tail.sub("", end).strip(" -,:;")) and shorter != end:
            end = shorter
            found.append(end)
        while text and before != text:
            found.append(text)
            before = text
            text = self.tail.sub("", self.lead.sub("", text)).strip(" -,:;")
            if self.field == "skill":
                text = re.sub(r"\s+v?\d+(?:\.\d+)*(?:\.x)?$", "", text)
            text = re.sub(r"\s*\([^)]*\)\s*$", "", text).strip() or text.strip("() ")
        return list(dict.fromkeys(x for c in found for x in (c, c.rstrip(". ")) if x))

    def written_out(self, token: str) -> list[str]:
        """What a word may stand for as a short form, itself included."""
        bare = token.rstrip(".")
        ways = [token, token.strip(".") if not token.startswith(".") else token, *SHORT.get(bare, [])]
        if token.endswith(".") and len(bare) >= 2:
            follows = re.compile(".*".join(map(re.escape, bare)))
            ways += sorted(w for w in self.with_word if len(w) > len(bare) + 1 and follows.match(w))
        return [*dict.fromkeys(w for w in ways if w)]

    def joined(self, ways: list[list[str]]) -> set[str]:
        """Keys without blanks that the words give one after another; followed only while some key begins so."""
        ends = {""}
        for words in ways:
            ends = {e + w for e in ends for w in words} & self.leading
        return ends & self.by_key.keys()

    def by_words(self, ways: list[list[str]], typing: bool) -> list[tuple[float, int]]:
        """(cost, entry) of the keys with these words in any order; with typing each word may hold errors."""
        if len(ways) not in self.sizes or len(ways) < 2:
            return []
        options: list[dict[str, tuple[int, float]]] = []
        for words in ways:
            own: dict[str, tuple[int, float]] = {}
            for k, w in enumerate(words):
                cost = 0.05 * (k > 0 and w != words[0].strip("."))
                if w in self.with_word:
                    own[w] = min(own.get(w, (9, 9.0)), (0, cost))
                for t in {t for d in deletes(w, in_word(len(w) + 1)) for t in self.near_word.get(d, ())} if typing else ():
                    if t != w and abs(len(t) - len(w)) <= in_word(len(t)):
                        d, weight = distance(w, t)
                        if d <= in_word(len(t)):
                            own[t] = min(own.get(t, (9, 9.0)), (d, weight + cost))
            if not own:
                return []
            options.append(own)
        keys = set.intersection(*[set().union(*[self.with_word[t] for t in own]) for own in options])
        found = []
        for key in keys:
            words = key.split()
            if len(words) == len(options):
                got = self.assigned(words, options, most(len(key)))
                if got is not None:
                    found.append((got, self.by_key[key]))
        return found

    @staticmethod
    def assigned(words: list[str], options: list[dict[str, tuple[int, float]]], edits: int) -> float | None:
        """Least cost at which the options take each word of a key once within so many edits."""
        # States: the words taken so far, as counts by spelling, with the edits spent; a key has few different words.
        spelled = sorted(set(words))
        states = {(tuple(words.count(t) for t in spelled), 0): (0.0, True)}
        for k, own in enumerate(options):
            later: dict = {}
            for (left, spent), (cost, ordered) in states.items():
                for at, t in enumerate(spelled):
                    if left[at] and t in own and spent + own[t][0] <= edits:
                        state = (left[:at] + (left[at] - 1,) + left[at + 1 :], spent + own[t][0])
                        way = (cost + own[t][1], ordered and words[k] == t)
                        if state not in later or (way[0], not way[1]) < (later[state][0], not later[state][1]):
                            later[state] = way
            states = later
        return min((c + 0.1 * (not o) for c, o in states.values()), default=None)

    def find(self, value: str) -> tuple[int, float, int, int]:
        """Stage (0: a known form, 1: with typing errors), cost, negative count and entry; the entry is -1 if none is near enough."""
        none = (9, 1e9, 0, -1)
        if FILLER.match(plain(value)) and plain(value) not in self.by_key:
            return none
        cores = self.cores(plain(value))
        plans = []
        for steps, core in enumerate(cores):
            spaced = loose(core)
            whole = {core: 0.0, spaced: 0.0}
            whole.setdefault(spaced.replace(" ", ""), 0.15)
            tokens = re.sub(r"[-_/,;|']+", " ", core).split()
            ways = [self.written_out(t) for t in tokens] if len(tokens) <= 2 * max(self.sizes, default=1) else []
            whole |= {k: 0.15 for k in (self.joined(ways) if ways else ()) if k not in whole}
            plans.append((steps * 0.01, {f: c for f, c in whole.items() if f}, ways))
        best = none
        for extra, whole, ways in plans:
            for form, cost in whole.items():
                if form in self.by_key:
                    i = self.by_key[form]
                    best = min(best, (0, cost + extra, -self.counts.get(i, 0), i))
            for cost, i in self.by_words(ways, False) if ways else ():
                best = min(best, (0, cost + extra, -self.counts.get(i, 0), i))
        if best[3] >= 0:
            return best
        for extra, whole, ways in plans:
            for form, cost in whole.items():
                near = {k for d in deletes(form, most(max(len(form), 4) + 1)) for k in self.index.get(d, ())}
                for key in near:
                    edits = min(most(len(key)), most(max(len(form), 4)) if len(key) < 8 else 2)
                    if abs(len(key) - len(form)) <= edits:
                        d, weight = distance(form, key)
                        if d <= edits:
                            i = self.by_key[key]
                            best = min(best, (1, weight + cost + extra, -self.counts.get(i, 0), i))
            for cost, i in self.by_words(ways, True) if ways else ():
                best = min(best, (1, cost + extra, -self.counts.get(i, 0), i))
        return best


def typed_values(hits: DataFrame) -> DataFrame:
    """One row (hit_id, field, item_pos, text) for each non-null role, location and element of skills."""
    each = F.concat(
        F.array(*[F.struct(F.lit(f).alias("field"), F.lit(0).alias("item_pos"), F.col(f).alias("text")) for f in ("role", "location")]),
        F.transform(F.coalesce(F.col("skills"), F.array().cast("array<string>")), lambda s, k: F.struct(F.lit("skill").alias("field"), (k + 1).alias("item_pos"), s.alias("text"))),
    )
    return hits.select("hit_id", F.explode(each).alias("e")).select("hit_id", "e.*").where("text is not null")


RESULT = "stage int, cost double, times bigint, canon_id int"


def resolved(hits: DataFrame, canon: DataFrame, other: dict | None = None) -> DataFrame:
    """hit_id, field, item_pos, text, canon_id of each typed value that is not literally an entry; -1 where none is meant."""
    spark = hits.sparkSession
    values = typed_values(hits)
    entries = canon.select("canon_id", "field", "value", "aliases").where("value is not null")
    exact = entries.select(F.col("field").alias("f"), F.col("value").alias("v"), "canon_id")
    # Spark's own choice: broadcast if it is small, else a join by value.
    counts = values.join(exact, (values.field == F.col("f")) & (values.text == F.col("v"))).groupBy("canon_id").agg(F.count("*").alias("n"))
    counted = common.saved(entries.join(counts, "canon_id", "left").select("canon_id", "field", "value", "aliases", F.coalesce("n", F.lit(0)).alias("n")), "entries")
    rest = values.join(exact.select("f", "v").distinct(), (values.field == F.col("f")) & (values.text == F.col("v")), "left_anti")
    blocks = max(1, -(-counted.count() // BLOCK))

    def sent(b: int):
        """Entries of one block; at most some BLOCK of them."""
        rows = counted.where(F.pmod(F.xxhash64("canon_id"), F.lit(blocks)) == b).collect()
        return spark.sparkContext.broadcast(([(r.field, r.canon_id, r.value, r.aliases) for r in rows], {r.canon_id: r.n for r in rows}, other))

    if blocks == 1:
        cost = _lookup(sent(0))(F.col("field"), F.col("text"))
        return rest.select("hit_id", "field", "item_pos", "text", cost.alias("c")).select("hit_id", "field", "item_pos", "text", F.col("c.canon_id").alias("canon_id"))
    # Each task holds one dictionary: the distinct values go through one after another, and the best answer of all counts.
    rest = common.saved(rest, "typed-values")
    typed = common.spread(rest.groupBy("field", "text").agg(F.count("*").alias("rows")).select("field", "text"))
    answers = None
    for b in range(blocks):
        look = _lookup(sent(b))
        part = common.saved(typed.select("field", "text", look("field", "text").alias("c")), "answers")
        answers = part if answers is None else answers.unionByName(part)
    best = answers.groupBy("field", "text").agg(F.min("c").alias("c"))
    return rest.join(best, ["field", "text"]).select("hit_id", "field", "item_pos", "text", F.col("c.canon_id").alias("canon_id"))


def found(hits: DataFrame, canon: DataFrame, other: dict | None = None) -> DataFrame:
    """hit_id, field, item_pos, canon_id. other: field to further names of values, OTHER if not given."""
    return resolved(hits, canon, other).drop("text")


def _lookup(sent):
    @F.pandas_udf(RESULT)
    def lookup(fields: pd.Series, texts: pd.Series) -> pd.DataFrame:
        own = _dictionaries(*sent.value)
        memory = own.setdefault("seen", {})
        if len(memory) > MEMORY:
            memory.clear()
        out = []
        for field, text in zip(fields, texts):
            got = memory.get((field, text))
            if got is None:
                got = memory[field, text] = own[field].find(text) if field in own else (9, 1e9, 0, -1)
            out.append(got)
        return pd.DataFrame(out, columns=["stage", "cost", "times", "canon_id"])

    return lookup


_KEPT: dict = {}


def _dictionaries(rows, written, other) -> dict:
    key = id(rows)
    if key not in _KEPT:
        _KEPT.clear()
        by = defaultdict(list)
        for field, i, value, aliases in rows:
            by[field].append((i, value, aliases))
        _KEPT[key] = {f: Dictionary(f, e, written, None if other is None else other.get(f, {})) for f, e in by.items()} | {"rows": rows}
    return _KEPT[key]


def p1_found(spark, sf_dir: str) -> DataFrame:
    return found(common.spread(common.table(spark, sf_dir, "hits").select("hit_id", "role", "location", "skills")), common.table(spark, sf_dir, "canonical_values"))


def p1_unmatched(spark, sf_dir: str) -> DataFrame:
    """Report of the values that mean no entry, with the number of times each was typed."""
    hits = common.table(spark, sf_dir, "hits").select("hit_id", "role", "location", "skills")
    rows = resolved(hits, common.table(spark, sf_dir, "canonical_values")).where("canon_id = -1")
    return rows.groupBy("field", "text").agg(F.count("*").alias("times"))
