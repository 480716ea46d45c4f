"""Each operator against brute force, exact round trips or cases known by hand."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cvloom.llm import common, p1_canonical, p2_neardup, p3_names, p4_pairs, p5_language, p6_pii, p7_encode, p8_mixture, p9_encoding
from cvloom.llm.boosting import Trees


# Problem 1
ENTRIES = [(1, "Java Developer", ["Sviluppatore Java"]), (2, "Data Engineer", ["Ingegnere dei dati"]), (3, "Business Analyst", ["Analista funzionale"])]


@pytest.mark.parametrize("typed,meant", [("java developer ", 1), ("Senior Java Devloper", 1), ("Developer, Java", 1), ("Sviluppatroe Java (freelance)", 1), ("Data Eng.", 2), ("ingegnere dei dati - consulente", 2), ("Business Anl.", 3), ("Bagnino", -1), ("n.d.", -1), ("", -1), ("   ", -1), ("x" * 5000, -1)])
def test_roles(typed, meant):
    assert p1_canonical.Dictionary("role", ENTRIES, {}).find(typed)[3] == meant


def test_places_and_skills():
    places = p1_canonical.Dictionary("location", [(7, "Milano", ["Milan"]), (8, "Roma", ["Rome", "RM"])], {})
    assert [places.find(x)[3] for x in ("zona Milano", "(MI)", "prov. RM", "Mialno e dintorni", "Rome - ibrido", "N/A", "Honolulu")] == [7, 7, 8, 7, 8, -1, -1]
    skills = p1_canonical.Dictionary("skill", [(9, "c#", ["csharp"]), (10, "node.js", ["nodejs"]), (11, "openshift", ["open shift"])], {})
    assert [skills.find(x)[3] for x in ("C# (base)", "conoscenza nodejs", "node.js 9.4", "opensfht", "uncinetto")] == [9, 10, 10, 11, -1]


def test_distance_is_a_true_damerau_distance():
    d = lambda a, b: p1_canonical.distance(a, b)[0]
    assert [d("ca", "abc"), d("guln", "gnu"), d("abc", "acb"), d("", "ab"), d("kitten", "sitting")] == [2, 2, 1, 2, 3]


def test_several_dictionaries_give_the_same(spark, small, monkeypatch):
    hits, canon = common.table(spark, small, "hits"), common.table(spark, small, "canonical_values")
    whole = {tuple(r) for r in p1_canonical.found(hits, canon).collect()}
    monkeypatch.setattr(p1_canonical, "BLOCK", 60)
    assert {tuple(r) for r in p1_canonical.found(hits, canon).collect()} == whole


def test_words_in_any_order_and_many_short_forms():
    long = [(1, "Senior Platform Reliability Data Systems Engineer", []), (2, "Data Platform Manager", ["Data Platform Mgr"])]
    find = lambda t: p1_canonical.Dictionary("role", long, {}).find(t)[3]
    assert find("Engineer Systems Data Reliability Platform Senior") == 1 and find("Enginer, Sistems Data Reliability Platform Senior") == 1
    assert find("Sen. Plat. Rel. Data Sys. Eng.") == 1 and find("Mgr Data Platform") == 2 and find("Data Data Platform Manager") == -1


def test_other_names_are_a_parameter():
    values = [(1, "Milano", [])]
    assert p1_canonical.Dictionary("location", values, {}, {"meneghina": "Milano"}).find("Meneghina")[3] == 1
    assert p1_canonical.Dictionary("location", values, {}, {}).find("MI")[3] == -1


def test_frequency_decides_between_equal_distances(spark):
    schema = "hit_id bigint, role string, location string, skills array<string>"
    hits = spark.createDataFrame([(k, "data analyst b", None, None) for k in range(9)] + [(20, "data analyst c", None, None), (21, "data analyst p", None, None)], schema)
    canon = spark.createDataFrame([(1, "role", "data analyst c", None), (2, "role", "data analyst b", None)], "canon_id int, field string, value string, aliases array<string>")
    assert {r.hit_id: r.canon_id for r in p1_canonical.found(hits, canon).collect()} == {21: 2}


# Problem 2
def documents(n=400, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [[rng.choice(vocabulary) for _ in range(80)] + [f"c{rng.randrange(40)}" for _ in range(30)] for _ in range(n // 4)]
    out = []
    for b in base:
        out.append(b)
        for share in (0.02, 0.06, 0.12):
            out.append([w if rng.random() > share else rng.choice(vocabulary) for w in rng.sample(b, len(b))])
    return [" ".join(x) for x in out]


def brute(texts, least=0.7):
    sets = {i: set(re.findall(r"[^\W_]+", t.lower())) for i, t in texts.items() if len(re.findall(r"[^\W_]+", t)) >= 70}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def found_pairs(spark, texts):
    hits = spark.createDataFrame([*texts.items()], "hit_id bigint, content string")
    pairs, members = p2_neardup.links(hits)
    group = {}
    for r in members.collect():
        group.setdefault(r.rep, []).append(r.id)
    got = {tuple(sorted((x, y))) for r in pairs.collect() for x in group[r.a] for y in group[r.b]}
    return got | {p for g in group.values() for p in itertools.combinations(sorted(g), 2)}


@pytest.mark.parametrize("limit", [1024, 8])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, limit):
    """With a low limit nodes are split into blocks and nothing is lost."""
    monkeypatch.setattr(p2_neardup, "LIMIT", limit)
    texts = dict(enumerate(documents()))
    texts |= {5000 + k: texts[k] for k in range(0, 40, 4)} | {9000: "short text", 9001: ""}
    want, got = brute(texts), found_pairs(spark, texts)
    assert got <= want and len(got) >= 0.98 * len(want)


def test_hot_group_of_copies_has_one_representative(spark):
    text = documents(4)[0]
    texts = {k: text for k in range(300)} | {1000 + k: t for k, t in enumerate(documents(200, 7))}
    _, members = p2_neardup.links(spark.createDataFrame([*texts.items()], "hit_id bigint, content string"))
    assert members.where("rep = 0").count() == 300


def test_pairs_equal_the_sql(spark, small):
    import duckdb

    from cvloom.llm import oracle_sql

    con = duckdb.connect()
    con.execute(f"CREATE VIEW hits AS SELECT * FROM '{small}/hits.parquet'")
    assert {tuple(r) for r in p2_neardup.p2_found(spark, small).collect()} == {*con.execute(oracle_sql()["p2_found"]).fetchall()}


# Problem 3
def same(a, b):
    g = p3_names.GIVEN
    return p3_names.same(p3_names.parse(a, g), p3_names.parse(b, g), g)


@pytest.mark.parametrize("a,b", [("Michela De Brodeloglu", "M. De Brodeloglu"), ("Guadalupe Buprichidru", "Lupe Buprichidru"), ("PRUSTUTRITO, AMÉLIE", "Amelie Prustutrito"), ("Th0mas van Fescinebri", "van Fescinebri, Thomas"), ("Dott. Luigi Domenico Dradirari", "Gigi Dradirari"), ("Luigi_DiZafitruti", "luigi di zafitruti"), ("Scoboglabro Software S.r.l.", "SCOBOGLABROSOFTWARE SRL"), ("Drocagoca Cons. S.p.A.", "Drocagoca Consulting S.p.A.")])
def test_same_name(a, b):
    assert same(a, b) and same(b, a)


@pytest.mark.parametrize("a,b", [("Michael Cazofrepu", "Silvia Cazofrepu"), ("Febredrupa Consulting Ltd.", "Febredrupa Software GmbH"), ("Bruno De Checurustu", "S. De Checurustu"), ("Elena Pibascagrò", "Pibascagrò Solutions S.r.l.")])
def test_other_name(a, b):
    assert not same(a, b)


def test_richer_profiles_match_again(spark):
    """'G. Mopechoda' joins through the spelling that another text gave its profile."""
    names = ["Gregory Mopechoda", "Gregory Mopechdoa", "G. Mopechoda", "Chiara Mopechoda", "NGA", None, " "]
    got = {r.name: r.entity for r in p3_names.resolve(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got["Gregory Mopechoda"] == got["Gregory Mopechdoa"] == got["G. Mopechoda"] != got["Chiara Mopechoda"] and "NGA" not in got


def entities(spark, names):
    return {r.name: r.entity for r in p3_names.resolve(spark.createDataFrame([(n,) for n in names], "name string")).collect()}


def test_given_names_of_one_letter_and_surname_stay_apart(spark):
    got = entities(spark, ["Marco Rossi", "Maria Rossi", "Mario Rossi", "Luisa Verdi", "Luigi Verdi", "Rossi, Marco", "M. Rossi", "L. Bianchi", "Luisa Bianchi"])
    assert len({got[f"{n} Rossi"] for n in ("Marco", "Maria", "Mario")}) == 3 and got["Luisa Verdi"] != got["Luigi Verdi"]
    assert got["Rossi, Marco"] == got["Marco Rossi"] == got["M. Rossi"] and got["L. Bianchi"] == got["Luisa Bianchi"]


def test_names_that_accept_two_errors_meet(spark):
    """Two letters apart, one in each half, with other given-name forms."""
    got = entities(spark, ["Robert Bartholomewson", "Bob Barsholomewton", "Bob Barsholomewten"])
    assert got["Robert Bartholomewson"] == got["Bob Barsholomewton"]
    words = ["sebugligu", "bartholomewson", "rossini", "abcdefg"]
    rng = random.Random(2)
    for _ in range(400):
        a = rng.choice(words)
        b = list(a)
        for _ in range(2):
            at = rng.randrange(len(b))
            b[at : at + 1] = rng.choice([[], [rng.choice("aeiobst")], [b[at], rng.choice("aeiobst")]])
        b = "".join(b)
        assert not p3_names.near(a, b) or p3_names.shorter(a) & p3_names.shorter(b)


def test_long_chains_of_spellings_end_in_one_entity(spark):
    """Each text meets the next one only; a fixed number of rounds would leave parts."""
    letters = "abcdefghijklmnopqrstuvwx"
    chain = ["Agata " + "".join(letters[k : k + 12]).capitalize() for k in range(10)]
    got = entities(spark, chain)
    assert len({*got.values()}) == 1


# Problem 4
def test_empty_and_copied():
    assert all(map(p4_pairs.empty, [None, "", " \n", "[]", "null", "```\n```", "​", "N/A", "...", "Match coerenti:\n- \n"]))
    assert not any(map(p4_pairs.empty, ["No.", "Match:\n- RTF, Java a Roma"]))
    q = "Cerco Java Developer a Roma."
    assert all(p4_pairs.without_question(q, r) is None for r in [q, q.upper(), f'"{q}"', f"Query: {q}", f"{q}\n{q}", "cerco java devloper a roma!!"])
    assert p4_pairs.without_question(q, f"{q}\n\nNessun candidato.").strip() == "Nessun candidato."


def test_refusals():
    says = lambda t: bool(p4_pairs.REFUSAL.search(p4_pairs.bare(t)))
    assert all(map(says, ["Mi dispiace, non posso aiutarti con questa richiesta.", "I am unable to provide information about candidates.", "Je préfère ne pas répondre.", "Über Bewerber darf ich keine Auskunft geben.", "No me está permitido hablar de los candidatos."]))
    assert not any(map(says, ["Non posso confermare la disponibilità di GCF, ma posso verificarla.", "No candidate meets every constraint: shall I search again?", "I cannot confirm when TAT is free."]))


def test_refusals_in_words_that_no_seed_has():
    seeds = [f"Mi dispiace, non posso {v} con questa richiesta di {n}." for v in ("aiutarti", "procedere", "aiutarla") for n in ("dati", "nomi", "profili", "contatti")]
    other = [f"Ho trovato {n} profili di {r} a Roma." for n in range(2, 9) for r in ("Java Developer", "Data Analyst", "UX Designer")] + [f"Non posso confermare la disponibilità di {n}, ma posso verificarla." for n in ("ABC", "DEF", "GHI")]
    counts = {}
    for text in seeds * 3 + other * 3:
        for x in p4_pairs.sentences(text):
            for f in ["", *p4_pairs.word_features(x)]:
                counts.setdefault(f, [0, 0])[not p4_pairs.REFUSAL.search(x)] += 1
    model = p4_pairs.Refusals([(f, *c) for f, c in counts.items()])
    new = "Mi dispiace, questa richiesta di contatti non posso accoglierla, aiutarla con questa richiesta no."
    assert not p4_pairs.REFUSAL.search(p4_pairs.bare(new)) and model.holds(new)
    assert not any(map(model.holds, other))


def test_edits_are_levenshtein():
    def plainly(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(4)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(90))) for _ in range(2))
        assert p4_pairs.edits(a, b) == plainly(a, b)
    assert p4_pairs.without_question("Cerco Java.", "Cerco Java.\n" * 9) is None


def test_rows_of_one_key_are_judged_each(spark, small):
    rows = common.table(spark, small, "evaluations").select("eval_id", "query", "response")
    once = sorted((r.eval_id, r.defect) for r in p4_pairs.judged(rows.unionByName(rows)).where("defect is not null").collect())
    one = p4_pairs.judged(rows.unionByName(rows).withColumn("eval_id", F.lit(1).cast("bigint"))).where("defect is not null")
    assert one.count() == len(once) and {d for _, d in once} == {r.defect for r in one.collect()}


# Problem 5
def test_language_of_held_out_texts(spark, small):
    """Models fitted on one part of the texts name the languages of the rest."""
    rows = common.table(spark, small.replace("0.001", "0.01"), "hits").where("content is not null").select("hit_id", F.col("content").alias("t"))
    model = p5_language.Model(*p5_language.trained(rows.where("hit_id % 2 = 0").select("t")), p5_language.TOKENIZERS)
    right = total = 0
    for r in rows.where("hit_id % 2 = 1").collect():
        parts = p5_language.paragraphs(r.t)
        seed = {p5_language.seed_language(p5_language.WORD.findall(p.lower())) for p in parts}
        if len(seed) == 1 and None not in seed:
            total += 1
            right += model.content(r.t)[0][1] == p5_language.LANGS[seed.pop()]
    assert total > 300 and right >= 0.99 * total


def test_forward_sums_all_segmentations():
    pieces = {"▁a": 0, "b": 1, "▁ab": 2, "▁": 3, "a": 4}
    p = np.array([[0.2], [0.3], [0.1], [0.25], [0.15]])
    got = p5_language.forward(*p5_language.spans("ab", pieces), p)[-1][0]
    assert abs(got - (0.2 * 0.3 + 0.1 + 0.25 * 0.15 * 0.3)) < 1e-12


def test_long_words_are_scored_whole():
    pieces = p5_language.vocabulary(p5_language.TOKENIZERS)
    p = p5_language.fit({"lavoro": np.array([9.0, 0, 0, 0, 0]), "work": np.array([0, 9.0, 0, 0, 0])}, pieces)
    longest = p5_language.longest_piece(p5_language.TOKENIZERS)
    for w in ("lavoro", "lavoroworkwork" * 2):
        got = p5_language.word_scores(w, p, pieces, longest)
        assert np.allclose(got, p5_language.log_forward(*p5_language.spans(w, pieces), p))
    a, b = (p5_language.word_scores("x" * 60 + w * 40, p, pieces, longest) for w in ("lavoro", "work"))
    assert a[0] > a[1] and b[1] > b[0]


def test_lattice_equals_the_forward_algorithm():
    pieces = {"▁a": 0, "b": 1, "▁ab": 2, "▁": 3, "a": 4}
    p = np.array([[0.2, 0.1], [0.3, 0.1], [0.1, 0.4], [0.25, 0.2], [0.15, 0.2]])
    words = ["ab", "a", "bxa", "aab"]
    lattice = p5_language.Lattice(words, pieces)
    for row, end, w in zip(lattice.forward(p), lattice.ends, words):
        assert np.allclose(row[end], p5_language.forward(*p5_language.spans(w, pieces), p)[-1])


def test_model_does_not_depend_on_partitions(spark, small):
    rows = common.table(spark, small, "hits").where("content is not null").select(F.col("content").alias("t"), F.col("language").alias("l"))
    one, many = ({(r.lang, r.word): r.n for r in p5_language.word_counts(rows.repartition(k)).collect()} for k in (1, 40))
    assert one == many


def rare_words(spark):
    """Texts of one language with 4,000 different words, each seen three times, and nothing else often."""
    letters = "abcdefgilmnoprstuvz"
    words = ["".join(x) + "are" for x in itertools.islice(itertools.product(letters, repeat=4), 4000)]
    texts = ["il lavoro di una della " + " ".join(words[k : k + 100]) for k in range(0, 4000, 100)] * 3
    return words, spark.createDataFrame([(t,) for t in texts], "t string")


def test_all_words_are_fitted(spark):
    words, texts = rare_words(spark)
    p, known, _ = p5_language.trained(texts)
    assert set(words) <= set(known)
    counts = {w: np.array([3.0, 0, 0, 0, 0]) for w in words} | {w: np.array([120.0, 0, 0, 0, 0]) for w in "il lavoro di una della".split()}
    assert np.array_equal(p, p5_language.fit(counts, p5_language.vocabulary(p5_language.TOKENIZERS)))
    few = dict(sorted(counts.items(), key=lambda x: (-x[1][0], x[0]))[:2500])
    assert not np.allclose(p, p5_language.fit(few, p5_language.vocabulary(p5_language.TOKENIZERS)), rtol=0.01)


def test_long_words_are_fitted():
    pieces = p5_language.vocabulary(p5_language.TOKENIZERS)
    longest = p5_language.longest_piece(p5_language.TOKENIZERS)
    short, long = (p5_language.fit({"work": np.array([0, 9.0, 0, 0, 0]), "lavoro" * n: np.array([9.0, 0, 0, 0, 0])}, pieces) for n in (5, 50))
    for p in (short, long):
        got = p5_language.word_scores("lavoro" * 2, p, pieces, longest)
        assert got[0] > got[1] + 5
    number = np.array([2.0, 0, 3.0, 0, 0])
    for w in ("lavoro", "hauptbahnhof", "x世y"):
        one, other = np.zeros((2, len(pieces), 5))
        for total, (k, lang, uses) in ((one, p5_language.long_expected(w, pieces, short, number)), (other, p5_language.Lattice([w], pieces).expected(short, number[None]))):
            np.add.at(total, (k, lang), uses)
        assert one.any() and np.allclose(one, other)


def test_lattice_has_the_spans_of_each_word():
    pieces = p5_language.vocabulary(p5_language.TOKENIZERS)
    words = ["lavoro", "a", "", "straße", "x世y", "internationalisierung", "12345"]
    lattice = p5_language.Lattice(words, pieces)
    for n, w in enumerate(words):
        own = lattice.w == n
        assert sorted(zip(lattice.i[own], lattice.j[own], lattice.k[own])) == sorted(p5_language.spans(w, pieces)[1])


def test_known_words_beyond_those_held_are_joined(spark, small, monkeypatch):
    """Words that a worker does not hold are known all the same; null, blank and repeated contents stay."""
    hits = common.table(spark, small, "hits").select("hit_id", "content", "language")
    hits = hits.unionByName(hits.where("hit_id % 50 = 0")).unionByName(spark.createDataFrame([(-1, None, "it"), (-2, " ", None)], hits.schema))
    whole = sorted(map(tuple, p5_language.languages(hits).collect()))
    monkeypatch.setattr(p5_language, "HOT", 60)
    assert sorted(map(tuple, p5_language.languages(hits.repartition(7)).collect())) == whole


def test_names_and_towns_do_not_change_a_language():
    assert p5_language.common_to_all(np.array([0.2, 0.25, 0.15, 0.2, 0.2])) and not p5_language.common_to_all(np.array([0.5, 0.45, 0.01, 0.02, 0.02]))
    assert p5_language.without_mail("Name a.b@c.test x.y (at) z.test (end)").split() == ["Name", "(end)"]


def test_labels():
    assert [p5_language.label_language(x) for x in ("it-IT", "Italiano", "ENG", "tedesco", "-", None, "und", "Français")] == ["it", "it", "en", "de", None, None, None, "fr"]


# Problem 6
PII = "Residente in Via dei Guvuze 34/B, codice fiscale MBSBPL19P85Z941B. Il responsabile diretto era Dott. Giulia Rossi, raggiungibile presso g.rossi (at) mail.test o al numero +39 355 011 7522 int. 4. Commessa 2012-205835-72 chiusa nel 2014-2016."


def test_redaction():
    given = p3_names.GIVEN
    model = p6_pii.trained([(PII, False), ("Tel. 355 010 2030, Order 4998.2416 closed during 2009-2011.", False)] * 30, given)
    spans = p6_pii.candidates(PII, given)
    kept = p6_pii.select(PII, spans, model.probability(np.array([p6_pii.features(PII, *s, given) for s in spans])))
    assert {(k, PII[a:b]) for k, a, b in kept} == {("address", "Via dei Guvuze 34/B"), ("id_number", "MBSBPL19P85Z941B"), ("name", "Giulia Rossi"), ("email", "g.rossi (at) mail.test"), ("phone", "+39 355 011 7522")}


def test_negatives_of_mail_and_streets():
    def label(text, part, kind, pattern):
        a = text.index(part)
        return p6_pii.clear_label(text, kind, a, a + len(part), pattern, p3_names.GIVEN, False)

    assert label("pip install tool@1.2.3 now", "tool@1.2.3", "email", 0) == 0 and label("git clone git@host.example:team/x", "git@host.example", "email", 0) == 0
    assert label("scrivere a g.rossi@mail.test grazie", "g.rossi@mail.test", "email", 0) == 1
    assert label("Frequentato Corso Java 2019 online", "Corso Java 2019", "address", 1) == 0 and label("abita in Corso Roma 20, 10100 Torino", "Corso Roma 20, 10100 Torino", "address", 1) == 1


def test_thresholds_are_fitted_by_type():
    kinds, rng = np.repeat([0.0, 1.0], 200), np.random.default_rng(1)
    y = rng.random(400) < 0.5
    p = np.where(kinds == 0, np.where(y, 0.45, 0.3), np.where(y, 0.9, 0.7))
    got = p6_pii.thresholds(kinds, p, y.astype(float))
    assert 0.3 < got["email"] <= 0.45 and 0.7 < got["phone"] <= 0.8 and got["name"] == p6_pii.THRESHOLD


def test_the_model_does_not_depend_on_the_order_of_rows(spark, small, monkeypatch):
    monkeypatch.setattr(p6_pii, "SAMPLE_TEXTS", 60)
    rows, names = p6_pii._input(spark, small)
    one, two = (p6_pii.model_for(rows.repartition(n, "text"), names)[0] for n in (1, 7))
    assert one.trees == two.trees and one.thresholds == two.thresholds


def test_boosted_trees_learn_and_are_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(3000) < 0.05)).astype(float)
    m = Trees().fit(x[:2000], y[:2000]).calibrate(x[2000:2500], y[2000:2500])
    p = m.probability(x[2500:])
    assert ((p > 0.5) == (y[2500:] > 0)).mean() > 0.88 and abs(p.mean() - y[2500:].mean()) < 0.05


# Problem 7
def test_automaton_round_trip_and_shared_suffixes():
    words = {w.encode(): [k, k + 1][: 1 + k % 2] for k, w in enumerate(sorted({a + b for a in ("ab", "abc", "x", "xyz", "è") for b in ("", "ing", "ings", "ed", "zzing")}))}
    lexicon = p7_encode.Lexicon(p7_encode.build(words))
    assert all(lexicon.find(w) == ids for w, ids in words.items()) and lexicon.find(b"abq") is None and lexicon.find(b"") is None
    assert len(lexicon.first) - 1 < sum(map(len, words))  # fewer states than letters
    assert p7_encode.Lexicon(p7_encode.build({})).find(b"a") is None


def test_ids_equal_the_library(spark, small):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{p7_encode.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    own = ["<|endoftext|> è", "  a\n\n b\t c", "東京🙂👩🏽‍💻", "it's we'll I'M", "\ud800" if False else "x" * 3000]
    docs = common.table(spark, small, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(10**9 + k, s) for k, s in enumerate(own)] + [(10**10, None), (10**10 + 1, "")], "doc_id bigint, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    fetched = {r.doc_id: r.ids for r in p7_encode.encode(docs, fetch=True).collect()}  # as from a file system that is not mounted
    for r in p7_encode.encode(docs).collect():
        assert r.ids == fetched[r.doc_id] == t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids


# Problem 8
def test_plan_is_exact_and_disjoint():
    rng = np.random.default_rng(3)
    blocks = [(s, k, int(n)) for s, m in (("a", 40), ("b", 12), ("c", 3)) for k, n in enumerate(rng.integers(800, 1200, m))]
    rows, total = p8_mixture.plan(blocks, [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("none", 0.0, 3)])
    size = {(s, k): n for s, k, n in blocks}
    got = {}
    for s, k, _, _, want in rows:
        got[s] = got.get(s, 0) + (size[s, k] if want is None else want)
    assert all(abs(got[s] / total - w) < 0.002 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    assert len({(s, k, c) for s, k, c, _, _ in rows}) == len(rows) and max(c for *_, c, _, _ in rows) <= 4


def test_splitting_tree_keeps_all_blocks():
    counts = np.array([57, 3, 0, 19])
    table = p8_mixture.split(counts, 7, np.random.default_rng(1))
    assert (table.sum(axis=0) == counts).all() and table.sum(axis=1).max() - table.sum(axis=1).min() <= 2


def test_shares_and_caps(spark, small):
    sf = small.replace("0.001", "0.01")
    goal = {r.source: r for r in common.table(spark, sf, "mix_targets").collect()}
    for r in p8_mixture.p8_shares(spark, sf).collect():
        assert r.most_repeats <= goal[r.source].max_repeats and abs(r.actual_share - r.target_share) < 0.02


# Problem 9
CLEAN = ["La sua attività principale è stata già così, perché più qualità", "Également responsable après le schéma", "Für Übersicht zuständig, außerdem Qualität", "También se ocupó según la gestión"]


def test_every_chain_round_trips():
    for written, read, times in p9_encoding.CHAINS:
        back = {v: k for k, v in p9_encoding.back(read).items()}
        for text in CLEAN:
            garbled = text
            try:
                for _ in range(times):
                    garbled = "".join(back[bytes([b])] for b in garbled.encode(written))
            except (KeyError, UnicodeEncodeError):
                continue
            if garbled != text:
                assert p9_encoding.undo(garbled, (written, read, times)) == text


def test_garbled_lines_are_found_and_restored(spark):
    rows, want = [], {}
    for k in range(200):
        text = f"{CLEAN[k % 4]}\nRiga {k} senza accenti"
        if k % 10 == 3:
            want[k] = text
            text = text.encode().decode(("latin-1", "mac_roman")[k % 20 == 3])
        rows.append((k, "feed" if k % 2 else None, text))
    rows += [(900, "feed", "SÃO PAULO, FORLÌ; ÀÈÌ"), (901, "feed", "├── src\n└── main"), (902, None, None), (903, "feed", ""), (904, "feed", "gi� qui")]
    got = {r.doc_id: r.text for r in p9_encoding.repaired(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()}
    assert set(got) == {*want, 904} and all(got[k] == t for k, t in want.items()) and got[904] is None


def test_other_scripts_read_byte_by_byte():
    for text in ("Привет", "Ελληνικά", "שלום"):
        garbled = "".join({v: k for k, v in p9_encoding.back("cp1252").items()}[bytes([b])] for b in text.encode())
        assert (("utf-8>cp1252", text) in p9_encoding.readings(garbled, {})) and p9_encoding.misread(garbled) and not p9_encoding.misread(text)
    assert not p9_encoding.readable("Приvетé") and p9_encoding.readable("è – é")


def test_lost_characters_are_filled_by_their_neighbours():
    pairs = {(a, b): -1.0 for w in ("così", "perché", "qualità") for a, b in zip(w, w[1:])}
    for token, want in (("cos\ufffd", "così"), ("perch\ufffd", "perché"), ("cos\ufffdperch\ufffdqualit\ufffd", "cosìperchéqualità")):
        assert p9_encoding.filled(token, pairs)[0] == want
    assert len(p9_encoding.filled("\ufffd" * 300, pairs)) == p9_encoding.FILLINGS


# Shared
def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (12, 11), (20, 20), (5, None)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(links, "src bigint, dst bigint")).collect()}
    assert got[3] == 1 and got[12] == 10 and {got[100 + k] for k in range(41)} == {100} and 20 not in got and 5 not in got
