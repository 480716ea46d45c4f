"""Problem 3: spellings of the same person or firm in hits.full_name.

Merge-and-rematch resolution over the distinct texts. A text is read as a person (given names, surname with its particles)
or a firm (name, trade, legal form). Profiles meet in blocks keyed by surnames and firm names with as many letters left out
as typing errors are allowed; within a block, in order, a profile joins the first it matches. Matches are merged: the merged
profile holds all spellings and initials of its parts and enters the blocks again with all their keys, until a round merges
nothing. Every round with a match leaves fewer profiles, so the rounds end.

Full given names of one surname must be forms of one another; an initial alone fits any of its letter and joins the first
such profile in order. Once a profile knows full given names, another with full ones must agree with one of them.

Null, blank and one-word texts and bare codes of three capitals name nobody; each text counts once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .p1_canonical import distance

#: Leading letters of a surname or firm name from which letters are left out for the blocks.
PREFIX = 12
#: A word is taken for a given name if it is in this share of the texts and in so many at least.
GIVEN_SHARE, GIVEN_LEAST = 0.001, 25
# Particles of surnames.
PARTICLES = frozenset("di de da del della dello dei degli dalla dal van von der den le la lo du des dos san mac mc".split())
# Titles before a name.
TITLES = re.compile(r"^(?:(?:dott|dottssa|dr|drssa|ing|sig|sigra|sigre|sigr|prof|profssa|avv|arch|geom|rag|mr|mrs|ms|miss|herr|frau|mme|mlle|sr|sra|srta|don|donna|dipl)\.?(?:ssa|ra|re|ina)?\.?\s+)+", re.I)
# Legal forms and trades of firms, with their usual short forms.
LEGAL = {"srl": "srl", "srls": "srl", "spa": "spa", "gmbh": "gmbh", "ltd": "ltd", "limited": "ltd", "sarl": "sarl", "sas": "sas", "snc": "snc", "inc": "inc", "llc": "llc", "plc": "plc", "ag": "ag", "kg": "kg", "bv": "bv", "nv": "nv", "sl": "sl", "coop": "coop"}
TRADES = {"software": "software", "sw": "software", "softw": "software", "solutions": "solutions", "solution": "solutions", "sol": "solutions", "servizi": "servizi", "serv": "servizi", "services": "servizi", "consulting": "consulting", "cons": "consulting", "consult": "consulting", "consulenze": "consulting", "informatica": "informatica", "inform": "informatica", "info": "informatica", "systems": "systems", "sistemi": "systems", "sist": "systems", "sys": "systems", "group": "group", "gruppo": "group", "technologies": "technologies", "tech": "technologies", "digital": "digital", "engineering": "engineering", "studio": "studio", "partners": "partners", "lab": "lab", "labs": "lab"}
LONG_TRADES = sorted((t for t in TRADES if len(t) > 4), key=len, reverse=True)
# Common given names, for small collections in which counts cannot tell them.
GIVEN = frozenset("""agata alessandra alessandro amelie andrea andrew anna antonella antonio arianna barbel beatrice benedetta benjamin bianca bruno carolina caterina cesare chiara christopher concepcion cristian daniela dario davide domenico edoardo edward eleonora elisabeth elisabetta elodie emanuele ernesto eugenio federica federico fernando filippo flavia francesca francesco francisca frederic friedrich gabriele genevieve giacomo gianluca giovanna giovanni giulia giuseppe gregory guadalupe gunther harriet ignacio ilaria irene jean-claude jennifer joaquin johannes jonathan jose jurgen katherine leonardo lorenzo lucia ludovica ludovico luigi maddalena marco margaret margherita maria martina massimiliano matteo matthew mercedes michael michela michele montserrat nathaniel nicola nicoletta noemi ottavia paolo patricia philip pierpaolo pietro raffaele raffaella rebecca riccardo richard robert roberto rodrigo rosalia rosario salvatore samantha samuele santiago sebastien serena silvia simona stefano susanna teresa theodore thomas tommaso umberto valentina valerio veronique victoria vincenzo vittoria wilhelmina william alberto angela angelo carla carlo claudia claudio cristina david elena emma enrico fabio franco giorgio james john laura luisa marcello mario paola sara sergio silvio vincent""".split())
# Pet names that are no part of the full name.
PET = {
    "bob": "robert roberto", "bobby": "robert roberto", "dick": "richard", "rick": "richard", "ricky": "riccardo richard", "becky": "rebecca", "mike": "michael michele", "miky": "michela michael", "miki": "michele michela michael", "mick": "michael", "tom": "thomas tommaso", "tommy": "thomas tommaso", "vicky": "vittoria victoria", "vicki": "victoria vittoria", "hattie": "harriet", "harry": "harriet", "lele": "gabriele raffaele emanuele daniele", "peggy": "margaret", "meg": "margaret", "maggie": "margaret", "gigi": "luigi", "ted": "edward theodore", "teddy": "edward theodore", "ned": "edward", "eddie": "edward", "beppe": "giuseppe", "pino": "giuseppe", "peppe": "giuseppe", "peppino": "giuseppe", "pippo": "filippo giuseppe pierpaolo", "pippi": "filippo", "lello": "raffaele", "lella": "raffaella antonella", "dade": "davide", "ginette": "genevieve", "gin": "genevieve", "gene": "genevieve", "charo": "rosario", "merche": "mercedes", "chicca": "federica francesca", "chicco": "federico francesco", "fritz": "friedrich", "lucy": "lucia", "nacho": "ignacio", "paco": "francisco francesco", "paca": "francisca", "kiko": "francisco", "pepe": "jose", "pepa": "josefa", "bill": "william wilhelmina", "billy": "william", "will": "william", "liz": "elisabeth elisabetta", "betty": "elisabetta elisabeth", "betta": "elisabetta", "lisa": "elisabetta elisabeth", "kate": "katherine caterina", "katie": "katherine", "kathy": "katherine", "cate": "caterina", "rina": "caterina", "jack": "giacomo", "giac": "giacomo", "mino": "giacomo", "mimmo": "domenico", "nico": "nicola nicoletta domenico", "toni": "antonio antonella", "tony": "antonio", "nino": "antonio", "tonino": "antonio", "toto": "salvatore antonio", "turi": "salvatore", "sasa": "salvatore", "gianni": "giovanni", "nanni": "giovanni", "vanni": "giovanni", "gio": "giovanni giovanna", "vanna": "giovanna", "enzo": "vincenzo lorenzo", "renzo": "lorenzo", "lori": "lorenzo", "max": "massimiliano", "massi": "massimiliano", "maxi": "massimiliano", "sandro": "alessandro", "drew": "andrew", "andy": "andrew", "chris": "christopher cristian", "kit": "christopher", "cris": "cristian", "concha": "concepcion", "conchita": "concepcion", "montse": "montserrat", "lupe": "guadalupe", "lupita": "guadalupe", "quim": "joaquin", "ximo": "joaquin", "santi": "santiago", "yago": "santiago", "rodri": "rodrigo", "rodro": "rodrigo", "hannes": "johannes", "hans": "johannes", "jo": "johannes", "mina": "wilhelmina", "willa": "wilhelmina", "jen": "jennifer", "jenny": "jennifer", "nate": "nathaniel", "nat": "nathaniel", "nathan": "nathaniel", "phil": "philip", "pip": "philip", "greg": "gregory", "pat": "patricia", "patty": "patricia", "trish": "patricia", "sam": "samantha samuele", "sammy": "samantha", "sery": "serena", "seb": "sebastien", "bastien": "sebastien", "nique": "veronique", "vero": "veronique", "fred": "frederic friedrich", "theo": "theodore", "susi": "susanna", "simo": "simona", "cesarino": "cesare", "ciccio": "francesco", "nando": "fernando", "berto": "umberto roberto", "carla": "carolina", "lina": "carolina", "titti": "margherita", "rita": "margherita", "marghe": "margherita", "meme": "mercedes",
}


def fold(text: str) -> str:
    """Lower case, no accents, digits that stand for letters written as these."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text.casefold().replace("ß", "ss")) if not unicodedata.combining(c)).replace("’", "'")
    return re.sub(r"(?<=[a-z])[01](?=[a-z\s,.]|$)|^[01](?=[a-z])|(?<=\s)[01](?=[a-z])", lambda m: "o" if m.group() == "0" else "l", text)


def letters(text: str) -> str:
    return re.sub(r"[^a-z]", "", text)


def near(a: str, b: str) -> bool:
    """Whether two words are the same but for typing errors."""
    if a == b:
        return True
    short = min(len(a), len(b))
    most = 0 if short < 4 else 1 if short < 7 else 2
    return most > 0 and abs(len(a) - len(b)) <= most and distance(a, b)[0] <= most


def shorter(text: str) -> set[str]:
    """The first letters of a text, whole and with up to as many left out as near() allows errors: equal for texts that near() takes for the same."""
    head = text[:PREFIX]
    most = 0 if len(text) < 4 else 1 if len(text) < 7 else 2
    found = {head}
    for _ in range(most):
        found |= {x[:i] + x[i + 1 :] for x in found for i in range(len(x))}
    return found


@lru_cache(maxsize=2)
def _by_shorter(given: frozenset) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for g in sorted(given):
        for x in shorter(g):
            found.setdefault(x, []).append(g)
    return found


def like_given(word: str, given: frozenset) -> float:
    """How much a word looks like a given name: as one (1), with typing errors (0.7) or not at all."""
    if word in given or word in PET or len(word) == 1:
        return 1.0
    index = _by_shorter(given)
    close = {g for x in shorter(word) for g in index.get(x, ()) if abs(len(g) - len(word)) < 2 and (g[0] == word[0] or g[-1] == word[-1])}
    return 0.7 if any(near(word, g) for g in close) else 0.0


def parse(text: str | None, given: frozenset) -> dict | None:
    """A form: {k: person, s: surname, g: given names} or {k: firm, s: name, t: trade, l: legal form}."""
    if not text or not text.strip() or re.fullmatch(r"\s*[A-Z]{3}\s*", text):
        return None
    raw = re.sub(r"\s+", " ", text.replace("_", " ")).strip()
    raw = re.sub(r"(?<=[a-zà-ÿ])(?=[A-Z][a-zà-ÿ]{2})", " ", raw)  # joined words
    low = TITLES.sub("", fold(raw)).strip()
    tokens = low.replace(",", " , ").split()
    bare = [letters(t) for t in tokens]
    legal = [LEGAL[b] for b, t in zip(bare, tokens) if b in LEGAL and (len(b) > 2 or "." in t)]
    if len(tokens) > 1 and (legal or any(b in TRADES and b != "lab" for b in bare) or any(b.endswith(t) and len(b) > len(t) + 4 for b in bare for t in LONG_TRADES)):
        trade, rest = "", []
        for b, t in zip(bare, tokens):
            if not b or (b in LEGAL and (len(b) > 2 or "." in t)):
                continue
            if b in TRADES:
                trade = TRADES[b]
                continue
            ending = next((x for x in LONG_TRADES if b.endswith(x) and len(b) > len(x) + 3), None)
            if ending and not trade:
                trade, b = TRADES[ending], b[: -len(ending)]
            rest.append(b)
        return {"k": "firm", "s": "".join(rest), "t": trade, "l": legal[0] if legal else ""} if rest else None
    if "," in tokens:
        at = tokens.index(",")
        last, first = bare[:at], bare[at + 1 :]
    else:
        words = [(letters(t), t) for t in tokens if letters(t)]
        w = [x for x, _ in words]
        glued = next((k for k, t in enumerate(tokens) if re.match(r"^(?:d|l|o)'[a-z]{3}", t)), None)
        joint = next((k for k, x in enumerate(w) if x in PARTICLES and k + 1 < len(w)), None)
        if joint is not None:
            end = joint + 1
            while end < len(w) - 1 and w[end] in PARTICLES:
                end += 1
            last, first = w[joint : end + 1], w[:joint] + w[end + 1 :]
        elif glued is not None and len(w) == len(tokens):
            last, first = [w[glued]], w[:glued] + w[glued + 1 :]
        elif len(w) < 2:
            return None
        else:
            if like_given(w[0], given) < like_given(w[-1], given):
                last, first = w[:1], w[1:]
            else:
                last, first = w[-1:], w[:-1]
    surname, names = "".join(last), [x for x in first if x]
    if not surname or not names or (len(surname) == 1):
        return None
    return {"k": "person", "s": surname, "g": names}


def pet(a: str, b: str) -> bool:
    """Whether a is a pet name or short form of b."""
    if len(a) < 2 or len(a) >= len(b) + 3:
        return False
    stem = re.sub(r"(?:etta|etto|ina|ino|ella|ello|y|i|ie|e|o|a)$", "", a) if len(a) > 3 else a
    return b in PET.get(a, "").split() or b.startswith(a) or (len(stem) >= 3 and b.startswith(stem)) or (len(a) >= 3 and len(a) < len(b) and a in b)


def same_given(a: str, b: str, given: frozenset) -> bool:
    if a == b:
        return True
    if len(a) == 1 or len(b) == 1:
        return a[0] == b[0]
    if a[:-1] == b[:-1] and a[-1] in "aeio" and b[-1] in "aeio":
        return False  # Simone and Simona, Mario and Maria
    if pet(a, b) or pet(b, a):
        return True
    return not (a in given and b in given) and near(a, b)


def same(x: dict, y: dict, given: frozenset) -> bool:
    """Whether two forms name the same one."""
    if x["k"] != y["k"]:
        return False
    if x["k"] == "firm":
        if x["l"] and y["l"] and x["l"] != y["l"]:
            return False
        trade = x["t"] == y["t"] or not x["t"] or not y["t"]
        if not trade:
            return False
        return near(x["s"], y["s"]) or near(x["s"] + x["t"], y["s"] + y["t"])
    a, b = x["g"], y["g"]
    if not near(x["s"], y["s"]) or not same_given(a[0], b[0], given):
        return False
    if len(a) > 1 and len(b) > 1 and x["s"] != y["s"]:
        return same_given(a[1], b[1], given)
    return True


def full(form: dict) -> bool:
    """Whether a form holds more than an initial of the given name."""
    return form["k"] == "firm" or len(form["g"][0]) > 1


def matches(p: list[dict], q: list[dict], given: frozenset) -> bool:
    """Whether two profiles agree; where both know full given names, these decide."""
    a, b = [x for x in p if full(x)], [y for y in q if full(y)]
    return any(same(x, y, given) for x in (a if a and b else p) for y in (b if a and b else q))


def keys(forms: list[dict]) -> set[str]:
    """Blocking keys of a profile: those of its surnames or names, and of firms with their trade."""
    found = set()
    for f in forms:
        found |= {f["k"][0] + x for x in shorter(f["s"])}
        if f["k"] == "firm" and f["t"]:
            found.add(f"f{f['s']}{f['t']}"[:PREFIX])
    return found


def given_names(names: DataFrame) -> frozenset:
    """Common given names: the fixed ones, and the words of so many texts; their number is bounded by the share."""
    n = names.count()
    least = max(GIVEN_LEAST, int(n * GIVEN_SHARE))
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit(r"(\p{L}{3,})"), F.lit(1))))
    rows = names.select(word.alias("w")).groupBy("w").count().where(F.col("count") >= least).collect()
    return GIVEN | {letters(fold(r.w)) for r in rows} - PARTICLES - {*LEGAL, *TRADES} - {"dott", "ing", "sig"}


class Block:
    """Profiles of one block, in order of arrival. A name that was met is found at once, so only new given names are compared with all."""

    def __init__(self, given: frozenset):
        self.given, self.seen, self.at = given, [], {}

    def join(self, ident: str, forms: list[dict], new: bool) -> str | None:
        """The profile that this one matches, which then holds its forms too; else None, and it is one of the block."""
        marks = {(f["k"], f["s"], f.get("t"), f.get("l")) if f["k"] == "firm" else (f["s"], f["g"][0]) for f in forms}
        hit = next((self.at[m] for m in marks if m in self.at and (new or self.seen[self.at[m]][2]) and matches(forms, self.seen[self.at[m]][1], self.given)), None)
        if hit is None:
            hit = next((k for k, s in enumerate(self.seen) if (new or s[2]) and matches(forms, s[1], self.given)), None)
        if hit is None:
            hit = len(self.seen)
            self.seen.append([ident, list(forms), new])
        own = self.seen[hit]
        for m in marks:
            self.at.setdefault(m, hit)
        if own[0] == ident:
            return None
        known = {json.dumps(x, sort_keys=True) for x in own[1]}
        own[1] += [x for x in forms if json.dumps(x, sort_keys=True) not in known]
        own[2] = True
        return own[0]


def resolve(names: DataFrame) -> DataFrame:
    """name, entity of every distinct text that names somebody; the entity is the least text linked to it."""
    spark = names.sparkSession
    names = common.saved(common.spread(names.where("name is not null").distinct()), "names")
    known = spark.sparkContext.broadcast(given_names(names))

    def read(batches):
        for part in batches:
            rows = [(n, json.dumps([f])) for n in part["name"] if (f := parse(n, known.value))]
            yield pd.DataFrame(rows, columns=["name", "forms"])

    # The same form is the same one: texts are gathered by form first, and only forms go through the blocks.
    members = common.saved(names.mapInPandas(read, "name string, forms string"), "members")
    profiles = common.saved(members.groupBy("forms").agg(F.min("name").alias("id")), "profiles")
    member = common.saved(members.join(profiles, "forms").select("name", F.col("id").alias("entity")), "members")
    profiles = profiles.withColumn("new", F.lit(True))

    def block(batches):
        for part in batches:
            rows = [(k, i, f, new) for i, f, new in zip(part.id, part.forms, part.new) for k in keys(json.loads(f))]
            yield pd.DataFrame(rows, columns=["key", "id", "forms", "new"])

    def link(batches):
        key, own, read = None, None, lru_cache(50_000)(json.loads)
        for part in batches:
            out = []
            for k, i, f, new in zip(part.key, part.id, part.forms, part.new):
                if k != key:
                    key, own = k, Block(known.value)
                hit = own.join(i, read(f), new)
                if hit is not None:
                    out.append((i, hit))
            yield pd.DataFrame(out, columns=["src", "dst"])

    @F.pandas_udf("string")
    def union(lists: pd.Series) -> pd.Series:
        return lists.map(lambda fs: json.dumps(list({json.dumps(x, sort_keys=True): x for f in fs for x in json.loads(f)}.values())))

    while True:
        rows = common.saved(profiles.mapInPandas(block, "key string, id string, forms string, new boolean"), "blocks")
        # Only blocks of several profiles, of them a new one, can hold a match.
        useful = rows.groupBy("key").agg(F.max("new").alias("any"), F.count("*").alias("n")).where("any and n > 1").select("key")
        blocks = rows.join(useful, "key", "left_semi")
        pairs = common.saved(blocks.repartition("key").sortWithinPartitions("key", "id").mapInPandas(link, "src string, dst string").distinct(), "links")
        if pairs.isEmpty():
            return member.select("name", "entity")
        merged = common.saved(common.components(pairs), "merged")
        joined = profiles.join(merged, "id", "left").select(F.coalesce("component", "id").alias("id"), "forms", F.col("component").isNotNull().alias("new"))
        # A profile gathers its different forms; it grows with the spellings of one entity, not with its rows or texts.
        gathered = joined.groupBy("id").agg(F.collect_set("forms").alias("f"), F.max("new").alias("new"))
        profiles = common.saved(gathered.select("id", union("f").alias("forms"), "new"), "profiles")
        member = common.saved(member.join(merged.withColumnRenamed("id", "entity"), "entity", "left").select("name", F.coalesce("component", "entity").alias("entity")), "members")


def p3_entities(spark, sf_dir: str) -> DataFrame:
    """name, entity: one row per text that names somebody."""
    return resolve(common.table(spark, sf_dir, "hits").select(F.col("full_name").alias("name")))


def p3_found(spark, sf_dir: str) -> DataFrame:
    rows = p3_entities(spark, sf_dir)
    return rows.select("entity", F.col("name").alias("name_a")).join(rows.select("entity", F.col("name").alias("name_b")), "entity").where("name_a < name_b").select("name_a", "name_b")
