"""Search requests: read from loose JSON, normalised, checked and turned into what retrieval needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

# Places of work that a request may name.
MODES = ("remote", "hybrid", "onsite", "unknown")
#: Fields of a request as text; lists as arrays of text.
BODY = "query STRING, skills ARRAY<STRING>, role STRING, location STRING, work_mode STRING, seniority STRING, min_experience_years STRING, max_experience_years STRING, language STRING, subco STRING, top STRING, hybrid STRING, strict STRING, relaxed_criteria ARRAY<STRING>, availability STRING, availability_date STRING, availability_days STRING, availability_required STRING"
FIELDS = {f.strip().split(" ")[0]: f.strip().split(" ")[1] for f in BODY.split(", ")}


def body(json: Column) -> Column:
    """A JSON body as a struct of BODY; what is no object is an empty one."""
    return F.from_json(F.when(F.trim(json).startswith("{"), json).otherwise("{}"), BODY)


def merged_body(query: Column, json: Column) -> Column:
    """A struct of BODY from parameters of the address (a map) where they are given, else from the body."""
    b = body(json)
    return F.struct(*[(F.coalesce(query[k], b[k]) if kind == "STRING" else F.coalesce(F.split(query[k], ","), b[k])).alias(k) for k, kind in FIELDS.items()])


def truth(c: Column) -> Column:
    """Truth of a loose flag: given, and neither empty, 0 nor false."""
    v = F.lower(F.trim(c))
    return F.coalesce(~v.isin("", "0", "false", "none", "null"), F.lit(False))


def normalised(r: DataFrame, keep: list[str]) -> DataFrame:
    """Requests in normal form, with the columns of keep. r may lack any column of BODY.

    skills: sorted set in lower case. top: 10 if none or no number, kept from 1 to 100. Years: as given, else read from the
    query. seniority: as given, else of the lower bound. availability_required: asked for, or any availability named.
    Blank texts are null; query is never null.
    """
    c = {k: F.col(k) if k in r.columns else F.lit(None).cast(kind.lower()) for k, kind in FIELDS.items()}
    text = {k: T.blank_to_null(c[k].cast("string")) for k, kind in FIELDS.items() if kind == "STRING"}
    low, high = T.experience_bounds(F.coalesce(text["query"], F.lit("")))
    top = F.coalesce(text["top"].try_cast("int"), F.lit(10))
    mode = F.lower(text["work_mode"])
    out = r.select(
        *keep, F.coalesce(text["query"], F.lit("")).alias("query"), T.clean_set(c["skills"]).alias("skills"), text["role"].alias("role"), text["location"].alias("location"),
        F.when(mode.isin(*MODES), mode).otherwise("unknown").alias("work_mode"), F.lower(text["seniority"]).alias("seniority_explicit"), text["language"].alias("language"), F.lower(text["subco"]).alias("subco"),
        F.greatest(F.lit(1), F.least(F.lit(100), F.when(top == 0, 10).otherwise(top))).alias("top"),
        F.coalesce(text["min_experience_years"].try_cast("double"), low).alias("min_experience_years"), F.coalesce(text["max_experience_years"].try_cast("double"), high).alias("max_experience_years"),
        T.clean_set(c["relaxed_criteria"]).alias("relaxed_criteria"), F.coalesce(truth(text["hybrid"]) | text["hybrid"].isNull(), F.lit(True)).alias("hybrid"), F.coalesce(truth(text["strict"]) | text["strict"].isNull(), F.lit(True)).alias("strict"),
        text["availability_date"].alias("availability_date"), text["availability_days"].try_cast("int").alias("availability_days"), (truth(text["availability_required"]) | truth(text["availability"])).alias("availability_required"),
    )
    years = F.col("min_experience_years")
    return out.withColumn("seniority", F.coalesce("seniority_explicit", V.seniority(years))).withColumn("seniority_inferred", F.col("seniority_explicit").isNull() & years.isNotNull())


def answerable() -> Column:
    """Whether a normalised request names a query, skills or a role."""
    return (F.col("query") != "") | (F.size("skills") > 0) | F.col("role").isNotNull()


def lexical_query() -> Column:
    """Words to look for: role and skills, else the query, else everything."""
    words = F.nullif(F.concat_ws(" ", F.col("role"), F.nullif(F.array_join("skills", " "), F.lit(""))), F.lit(""))
    return F.coalesce(words, F.nullif(F.col("query"), F.lit("")), F.lit("*"))


def moment(c: Column) -> Column:
    """Time of an ISO text with or without zone, with 'T' or a blank; without zone it is UTC. Anything else is null."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), " (?=[0-9]{2}:)", "T"), "Z$", "+00:00")
    day = F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.concat(t, F.lit("T00:00:00+00:00")))
    full = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?$"), F.concat(t, F.lit("+00:00")))
    zoned = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?[+-][0-9]{2}:?[0-9]{2}$"), t)
    return F.coalesce(day, full, zoned).try_cast("timestamp")


def wanted_days(days: Column, date: Column, today: Column) -> Column:
    """Days until which somebody must be free: as given, else until the date, 0 at least; null if neither is readable."""
    until = F.datediff(F.to_date(F.to_utc_timestamp(moment(date), "UTC")), today)
    return F.coalesce(F.when(days >= 0, days), F.greatest(F.lit(0), until))


def index_name(subco: Column, routes: dict[str, str] | None = None, default: str = "chunks") -> Column:
    """Table that a company's requests go to."""
    return reduce(lambda out, r: F.when(subco == r[0], r[1]).otherwise(out), (routes or {}).items(), F.lit(default))


def envelope(data: Column, error: Column, request_id: Column) -> Column:
    """Answer as JSON: success, data, error and the request's id; nulls are written."""
    return F.to_json(F.struct(error.isNull().alias("success"), F.when(error.isNull(), data).alias("data"), error.alias("error"), request_id.alias("request_id")), {"ignoreNullFields": "false"})


# Kinds of requests of the evaluation set and what varies in them. The requests are built, not listed.
ROLES = ("Java Developer", "Data Engineer", "Business Analyst", "DevOps Engineer", "UX Designer", "Project Manager", "QA Engineer")
TOWNS = ("Milano", "Roma", "Torino", "Bologna", "Napoli")
KINDS = {
    "role": "Cerco un {role}.", "role_town": "Cerco un {role} a {town}.", "role_years": "{role} con almeno {n} anni di esperienza", "range": "{role}, tra {n} e {m} anni", "remote": "{role} da remoto", "english": "I need a {role} in {town}.",
    "skills": "Profili con esperienza in {skill} e {other}", "availability": "{role} disponibile entro {d} giorni", "seniority": "Senior {role} a {town}", "language": "{role} con inglese fluente", "hybrid": "{role} ibrido a {town}", "team": "Un team con {role} e {role2}",
    "vague": "Serve qualcuno di bravo", "typo": "{role_typo} a {town}", "long": "Per un progetto di {n} mesi a {town} serve un {role} con {skill}, {other} e buone doti di comunicazione", "negation": "{role} ma non a {town}", "compare": "Meglio un {role} o un {role2} per {skill}?", "followup": "E con {skill}?",
}
SKILLS = ("java", "spring boot", "python", "docker", "kubernetes", "react", "power bi")


def evaluation_requests(n: int = 175) -> list[tuple[str, str]]:
    """(title, query) of an evaluation set: every kind in turn with roles, towns, skills and numbers in turn."""
    kinds = [*KINDS.items()]
    out = []
    for k in range(n):
        title, form = kinds[k % len(kinds)]
        turn = k // len(kinds)
        role = ROLES[(turn + k) % len(ROLES)]
        out.append((title, form.format(role=role, role2=ROLES[(turn + k + 3) % len(ROLES)], role_typo=role[:2] + role[3:], town=TOWNS[(turn + k) % len(TOWNS)], n=2 + turn % 6, m=5 + turn % 6, d=15 * (1 + turn % 4), skill=SKILLS[k % len(SKILLS)], other=SKILLS[(k + turn + 2) % len(SKILLS)])))
    return out
