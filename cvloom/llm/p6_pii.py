"""Problem 6: personal information in free text, found and replaced by typed placeholders.

Generators with high recall propose overlapping spans: e-mail addresses however written, telephone and identity numbers,
street addresses and names. Boosted trees judge each span by its format and by the words around it, trained on a bounded
sample of spans whose context leaves no doubt (a label such as "Tel." or "Order no." right before). Scores are calibrated
on a held-out part, on which each type's threshold is fitted too; of overlapping spans over it the best ones remain.

Null and blank texts give nothing; repeated rows are found each, equal spans of a row once.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .boosting import Trees
from .p3_names import LEGAL, PARTICLES, TRADES, fold, given_names, letters

TYPES = ("email", "phone", "id_number", "address", "name")
#: Contents in the training sample at most (a sixth of it for each other column).
SAMPLE_TEXTS = 5_000
#: Threshold on the calibrated probability of a type with fewer held-out spans of either class than the second number, and
#: the bounds within which it is fitted otherwise.
THRESHOLD, HELD_OUT, BOUNDS = 0.5, 20, (0.2, 0.8)
#: What makes a thing like an address of mail a path, a version or a package.
NO_MAIL_BEFORE, NO_MAIL_AFTER, NO_MAIL = re.compile(r"(?:[/=]|git |npm |pip |clone )$"), re.compile(r"[:/]\S"), re.compile(r"@v?\d|\.\d+$", re.I)
#: A course and its year, not a street and its number; and what only an address has after the number.
COURSE, AT_HOME = re.compile(r"(?:corso|strada|largo|place) .*\b(?:19|20)\d\d$", re.I), re.compile(r"\d\D+\d{5}|\d(?:\s?/?[A-Za-z])?\s*(?:,|-|–)\s+[A-ZÀ-Ý]")
# Words around a span, by what they speak for.
NEAR_WORDS = {
    "contact": "tel telefono telefon téléphone teléfono phone cell cellulare mobile mobil portable chiamare call appeler llamar anrufen numero casa fisso whatsapp fax recapiti contacts oder contatti referenze",
    "mail": "email mail posta courriel correo scrivere write écrire escribir mailto recapiti contacts presso at an schreiben",
    "identity": "documento document fiscale cf id ausweis pièce dni nif nie passaporto passport identità personalausweis holder carta codice ssn nino nir sécurité tessera identity",
    "order": "pratica commessa order auftrag pedido commande ticket expediente dossier vorgang versione version versión fassung release build rilascio partita batch lote charge lot issues prot protocollo fattura invoice rechnung factura facture offerta ordine nr",
    "home": "domicilio residente abita address lives wohnhaft habite vive flat indirizzo adresse anschrift dirección home shares famiglia family familie",
    "person": "responsabile indicazione contattare referenze references referenzen referencias références advice manager leitung rat consejo jefe conseil responsable nome name nom nombre cognome referente era was hatte von candidato candidate sottoscritto",
    "title": "dott dottssa dr drssa ing sig sigra prof avv mr mrs ms miss frau herr mme mlle sr sra dña don d m arch geom",
    "thing": "progetto project projekt proyecto projet sede site modulo module módulo laboratorio lab labor schema scheme muster esquema schéma fornitore vendor lieferanten proveedor fournisseur bando tender ausschreibung concurso appel reparto unit abteilung departamento service per for für para pour standort baustein via viale corso piazza",
}
CLASS = {}
for _k, _words in enumerate(NEAR_WORDS.values()):
    for _w in _words.split():
        CLASS[_w] = CLASS.get(_w, 0) | 1 << _k
N_CLASSES = len(NEAR_WORDS)
# Words that introduce a person right before the name (last words of the context, without case).
LEADS = re.compile(r"(?:responsabile (?:diretto )?era|su indicazione di|referenze contattare|contattare|references?:|referenzen:|referencias:|références ?:|referenze:|on the advice of|line manager was|manager was|leitung hatte|auf rat von|por consejo de|jefe (?:directo )?era|sur le conseil de|responsable était|il sottoscritto|candidat[oea]:|referente:|sincerely,?|signed,?|firmato,?) ?$", re.I)
TITLE = re.compile(r"(?:^|[^\w.])(?:(?:dott(?:\.?ssa)?|dr(?:\.?ssa)?|ing|sig(?:\.?ra|\.?na)?|prof(?:\.?ssa)?|avv|arch|geom|rag|mr|mrs|ms|miss|herr|frau|mme|mlle|sr|sra|srta|dña|don|doña)\.?|[dD]\.) $", re.I)
#: Leads after which "M." is a title, not an initial.
FRENCH = re.compile(r"(?:conseil de|responsable était|références ?:) ?$", re.I)
TITLE_START = re.compile(r"^(?:(?:dott(?:\.?ssa)?|dr(?:\.?ssa)?|ing|sig(?:\.?ra|\.?na)?|prof(?:\.?ssa)?|avv|arch|geom|rag|mr|mrs|ms|miss|herr|frau|mme|mlle|sr|sra|srta|dña|don|doña)\b\.?|m\.(?= [A-ZÀ-Ý][a-zà-ÿ]+$)|d\.(?= [A-ZÀ-Ý][a-zà-ÿ]+ ))\s+", re.I)
LABEL = re.compile(r"^[-*•| \t]*\**(?:nome(?: e cognome)?|name|full name|nom(?: complet)?|nombre(?: completo)?|cognome e nome|vollständiger name)\**\s*(?:[:|]\s*|\s(?=\S))\**(?P<v>[^|\n]+?)\**\s*(?:\||$)", re.I | re.M)
BEFORE_MAIL = re.compile(r"(?P<v>[^\W\d][^<>@\n|,;:]{2,60}?)\s*<(?=[^<>\s]+@)")
AT, DOT = r"(?:\s?@\s?|\s?[(\[]\s?(?:at|chiocciola)\s?[)\]]\s?|\s(?:chiocciola|at|arroba)\s)", r"(?:\.|\s?[(\[]\s?(?:dot|punto)\s?[)\]]\s?|\s(?:punto|dot)\s)"
EMAIL = re.compile(rf"(?<![\w.+-])[^\W_](?:[\w+.'-]|(?:\s?\[dot\]\s?))*{AT}[^\W_][\w-]*(?:{DOT}[^\W_][\w-]*)+", re.I)
PHONE = re.compile(r"(?<![\w/.-])(?=[+(\d])(?:\(\+?\d{1,4}\)|\+\d{1,3}|00\d{1,3})?[ .-]?(?:\(0?\d{1,4}\)[ .-]?)?\d(?:[ ./-]?\d){5,13}(?![\w/]|[.-]\d)")
IDENTITY = [
    re.compile(p)
    for p in (
        r"(?<!\w)[A-Za-z]{6} ?\d{2}[A-Za-z]\d{2} ?[A-Za-z]\d{3}[A-Za-z](?!\w)",
        r"(?<!\w)[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z](?!\w)",
        r"(?<![\w/])[A-Z]{2}\d{5}[A-Z]{2}(?!\w)",
        r"(?<![\w/])[A-Z]{2} ?\d{7}(?!\w)",
        r"(?<![\w/])[A-Z]\d{8}(?!\w)",
        r"(?<![\w./-])\d{8}-? ?[A-Z](?!\w)",
        r"(?<!\w)[XYZ]-?\d{7}-?[A-Z](?!\w)",
        r"(?<!\w)\d{2}[A-Z]{2}\d{5}(?!\w)",
        r"(?<![\w/])(?=[A-Z0-9]{9,10}(?!\w))[A-Z]{1,2}\d(?=[A-Z0-9]*\d)[A-Z0-9]{6,8}(?!\w)",
        r"(?<![\w./+-])\d \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}(?!\w)",
        r"(?<![\w./+-])\d{13}(?: ?\d{2})?(?!\w)",
        r"(?<![\w./+-])\d{3}[- ]\d{2}[- ]\d{4}(?!\w)",
        r"(?<![\w./+-])\d{9}(?!\w)",
    )
]
ANY_IDENTITY = re.compile(r"(?<![\w./+-])(?=[A-Za-z]{0,6} ?\d)(?:" + "|".join(f"(?P<p{k}>{p.pattern})" for k, p in enumerate(IDENTITY, 1)) + ")")
CAP = r"[A-ZÀ-Ý][\w'’]*(?:-[A-ZÀ-Ý][\w'’]*)*"
TOWN = rf"(?!(?:Ausweis|Documento|Document|Codice|CF|Tel|Cell|Mobil|Pièce|Email)\b){CAP}(?: (?:(?:di|del|am|an der|sur|de|la) )?{CAP}){{0,2}}"
PLACE = rf"(?:\s*(?:,|-|–)?\s+\d{{5}}(?:\s*,?\s+{TOWN})?|\s*(?:,|-|–)\s+{TOWN})?"
NUMBER = r"\d{1,4}(?:\s?/\s?[A-Za-z]\b|\s?(?:bis|ter)\b|[A-Za-z]\b)?"
ITALIAN = r"(?:[Vv]ia|[Vv]iale|[Vv]\.le|[Cc]orso|[Cc]\.so|[Pp]iazza|[Pp]\.zza|[Pp]iazzale|[Pp]\.le|[Vv]icolo|[Ll]argo|[Ss]trada|[Cc]ontrada|VIA|VIALE|CORSO|PIAZZA|VICOLO)"
ADDRESS = [
    re.compile(rf"(?<!\w){ITALIAN} (?:(?:dei|delle|del|della|degli|di|dell['’]|San|Santa|Sant['’]) ?)?{CAP}(?: {CAP}){{0,2}},?(?: (?:n\.|n°|nr\.|numero))? {NUMBER}{PLACE}"),
    re.compile(rf"(?<!\w)(?:(?:[Ff]lat|[Aa]partment|[Aa]pt\.?|[Uu]nit) \w{{1,4}}, )?\d{{1,4}}[A-Za-z]? {CAP}(?: {CAP})? (?:Street|Road|Lane|Ave\.|Avenue|St\.|Rd\.|Drive|Close|Court|Square|Way|STREET|ROAD|LANE)(?!\w){PLACE}"),
    re.compile(rf"(?<!\w)\d{{1,4}}(?: (?:bis|ter))?,? (?:rue|bd|boulevard|avenue|av\.|place|allée|chemin|impasse|quai|RUE|BD|AVENUE) (?:(?:de la|du|des|de|d['’]) ?)?{CAP}(?: {CAP}){{0,2}}{PLACE}"),
    re.compile(rf"(?<!\w)(?:[Cc]alle|[Aa]venida|[Aa]vda\.|[Aa]v\.|[Cc]/|[Pp]laza|[Pp]za\.|[Pp]aseo|CALLE|AVENIDA) ?(?:(?:de la|del|de los|de las|de) )?{CAP}(?: {CAP}){{0,2}},?(?: n[.º°])? {NUMBER}{PLACE}"),
    re.compile(rf"(?<!\w)(?:(?:Am|An der|Im|Zum|Zur|Auf dem|In der) )?{CAP}(?<=[a-zß])(?:(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|ufer))?,? {NUMBER}{PLACE}"),
]
GERMAN = re.compile(r"(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|ufer),? \d", re.I)
WORDS = re.compile(r"[^\W\d_]+")
CAPITAL = re.compile(r"[A-ZÀ-Ý][\w'’]*(?:-[A-ZÀ-Ý][\w'’]*)*\.?")
LOWER = re.compile(r"(?:era|indicazione di|contattare|[Rr]eferences:|[Rr]eferenzen:|[Rr]eferencias:|[Rr]éférences ?:|advice of|manager was|hatte|Rat von|consejo de|conseil de|était) (?:(?:dott(?:\.?ssa)?|dr|ing|sig(?:\.?ra)?|prof|avv|mr|mrs|ms|frau|herr|mme|sr|sra|dña|m)\.? )?(?P<v>[a-zà-ÿ][\wà-ÿ'’]*(?: [a-zà-ÿ][\wà-ÿ'’]*){1,4})")
#: Titles as tokens.
STARTING = frozenset("dott. dottssa. dr. ing. sig. prof. avv. mr. mrs. ms. frau. herr. mme. sr. sra. dña. don. dna. arch. geom. rag. sigra. miss. mlle. srta.".split())
STOP = frozenset("the il la lo le se wurde team equipo gruppo gruppe équipe was al at who phone telefono telefon teléfono téléphone raggiungibile und and et y e".split())


@lru_cache(maxsize=200_000)
def _folded(word: str) -> str:
    return fold(word)


# Parts of leads and of street words, for a quick look whether a text holds any.
LEAD_PARTS = ("responsabile", "indicazione", "contattare", "eferen", "advice of", "manager was", "hatte", "rat von", "consejo", "jefe", "conseil", "responsable", "sottoscritto", "sincerely", "signed", "firmato", "référence")
STREET_PARTS = (
    ("via ", "viale ", "v.le ", "corso ", "c.so ", "piazza", "p.zza ", "p.le ", "vicolo ", "largo ", "strada ", "contrada "),
    (" street", " road", " lane", " ave", " st.", " rd.", " drive", " close", " court", " square", " way"),
    (" rue ", " bd ", " boulevard ", " avenue ", " av. ", " place ", " allée ", " chemin ", " impasse ", " quai "),
    ("calle ", "avenida ", "avda. ", "av. ", "c/", "plaza ", "pza. ", "paseo "),
)
GERMAN_PARTS = ("straße", "strasse", "str. ", "weg ", "weg,", "platz ", "platz,", "gasse ", "allee ", "ring ", "ufer ")
NUMBERS = re.compile(r"\d[ ./)-]*\d{2}[\d ./()-]{3,}|[A-Za-z]\d|\d[A-Za-z]|\d{7}|\d \d{2} \d{2}|[A-Z]{2} \d{2} ")
LEADS_ANY = re.compile(LEADS.pattern.rstrip("$"), re.I)
#: Titles as the word before a name.
TITLES = frozenset("dott dott.ssa dottssa dr dr.ssa drssa ing sig sig.ra sigra sig.na prof prof.ssa avv arch geom rag mr mrs ms miss frau herr mme mlle sr sra srta dña don doña".split())


#: Parts of titles, for a quick look whether a text holds any.
TITLE_PARTS = ("dott", "dr. ", " dr ", "drssa", "dr.ssa", "ing. ", " ing ", "sig. ", "sig.", "prof", "avv", "arch.", "geom", "rag.", "mr. ", "mr ", "mrs", " ms ", "ms. ", "miss", "frau ", "herr ", "mme", "mlle", "sr. ", " sr ", "sra", "srta", "dña", "doña", " don ")


def title_at(text: str, a: int) -> int:
    """Start of the title right before position a, or -1."""
    if text[a - 1 : a] != " ":
        return -1
    at = max(text.rfind(" ", max(0, a - 12), a - 1), text.rfind("\n", max(0, a - 12), a - 1), text.rfind("|", max(0, a - 12), a - 1)) + 1
    word = text[at : a - 1]
    return at if word.rstrip(".").lower() in TITLES else -1


_STARTERS: dict[str, bool] = {}


def _starter(word: str, given: frozenset) -> bool:
    """Whether a capital word may start a name by itself: a given name or an initial. Answers are remembered."""
    got = _STARTERS.get(word)
    if got is None:
        if len(_STARTERS) > 300_000:
            _STARTERS.clear()
        own = _folded(word.rstrip("."))
        got = _STARTERS[word] = (len(word) == 2 and word[1] == ".") or own in given or ("_" in own and own.split("_")[0] in given)
    return got


def firm(text: str) -> bool:
    found = [letters(fold(t)) for t in re.split(r"[\s,]+", text)]
    return any((b in LEGAL and len(b) > 2) or b in TRADES or any(b.endswith(t) and len(b) > len(t) + 3 for t in ("software", "solutions", "servizi", "consulting", "informatica")) for b in found)


def name_spans(text: str, given: frozenset) -> list[tuple[int, int]]:
    """Spans that may be names: after labels, leads and titles, and where a given name or an initial starts one."""
    found = []
    low = text.lower()
    leads = {m.end() for m in LEADS_ANY.finditer(text)} if any(x in low for x in LEAD_PARTS) else set()
    for pattern in (LABEL, BEFORE_MAIL):
        if ("<" not in text) if pattern is BEFORE_MAIL else ("nom" not in low and "name" not in low):
            continue
        for m in pattern.finditer(text):
            a, b = m.span("v")
            value = m["v"].strip()
            a += len(m["v"]) - len(m["v"].lstrip())
            if (t := TITLE_START.match(value)):
                a, value = a + t.end(), value[t.end() :]
            if 2 < len(value) <= 60 and not firm(value) and len([x for x in re.split(r"[\s,_]+", value) if x]) > 1:
                found.append((a, a + len(value)))
    tokens = [(m.start(), m.end(), m.group()) for m in CAPITAL.finditer(text)]
    titled = any(x in low for x in TITLE_PARTS)
    starts = [k for k, (a, _, w) in enumerate(tokens) if _starter(w, given) or a in leads or (titled and a > 2 and title_at(text, a) >= 0)]
    n, k = len(tokens), 0
    for k0 in starts:
        if k0 < k:
            continue
        k = k0
        a, b, word = tokens[k]
        own = _folded(word.rstrip("."))
        initial = len(word) == 2 and word[1] == "."
        known = own in given or ("_" in own and own.split("_")[0] in given)
        head = title_at(text, a) if a > 2 else -1
        title = head >= 0
        lead = a in leads or head in leads
        if not (known or initial or title or lead):
            k += 1
            continue
        before = text[max(0, a - 40) : a]
        if not (known or initial or title or lead) or own in STOP or (own + "." in STARTING and not initial):
            k += 1
            continue
        if word == "M." and FRENCH.search(before) or (word == "D." and lead and k + 1 < n and _folded(tokens[k + 1][2].rstrip(".")) in given):
            k += 1
            if k < n and tokens[k][0] == b + 1:
                tokens[k] = (*tokens[k][:2], tokens[k][2])
                title = lead = True
                a, b, word = tokens[k]
                own, initial = _folded(word.rstrip(".")), len(word) == 2 and word[1] == "."
            else:
                continue
        end, j, size, caps = b, k + 1, 1, word.isupper() and len(word) > 2
        full = not initial and own not in PARTICLES
        if word[-1] == "." and not initial:
            end, closed = b - 1, True
        else:
            closed = False
        while j < n and size < 6 and not closed:
            x, y, w = tokens[j]
            gap = text[end:x]
            f = _folded(w.rstrip("."))
            if gap not in (" ", "  ", ""):
                inner = gap.strip()
                if gap[:1] == " " and inner in PARTICLES and gap.count(" ") == 2:
                    pass
                elif gap == ", " and full and size <= 3 and (f in given or len(w) == 2 and w[1] == ".") and (title or lead) and not known:
                    pass
                else:
                    break
            if gap == "" and not (len(text[end - 2 : end]) == 2 and text[end - 1] == "."):
                break
            if caps and f in STOP or (not caps and w.isupper() and len(w.rstrip(".")) > 1):
                break
            if w[-1] == "." and len(w) != 2:
                y, closed = y - 1, True
            full = full or (not (len(w) == 2 and w[1] == ".") and f not in PARTICLES)
            end, size, j = y, size + 1, j + 1
        # An initial at the end keeps its full stop ("Rossi M."), unless a given name stands before it all.
        value = text[a:end]
        if full and (size > 1 or title or lead or "_" in value) and not firm(value) and not re.fullmatch(r"[A-Z]{3}", value):
            # All-capital text runs on: a name is a given name, at most one more, particles and a surname.
            if caps and size > 2:
                words, length, seen = value.split(" "), 0, 0
                for w in words:
                    length += len(w) + 1
                    seen += _folded(w) not in PARTICLES and _folded(w) not in given
                    if seen:
                        break
                value, end = value[: length - 1], a + length - 1
            found.append((a, end))
        k = max(j, k + 1)
    # After a lead a name may be typed in lower case.
    for m in LOWER.finditer(text) if leads else ():
        a = m.start("v")
        w = m["v"].split(" ")
        if _folded(w[0]) in given or _folded(w[-1]) in given or _folded(w[0]) in PARTICLES:
            keep = w[:1]
            for x in w[1:]:
                if _folded(x) in STOP or (len(keep) > 1 and keep[-1] not in PARTICLES and _folded(keep[-1]) not in given):
                    break
                keep.append(x)
            if len(keep) > 1:
                found.append((a, a + len(" ".join(keep))))
    return list(dict.fromkeys(found))


def candidates(text: str, given: frozenset) -> list[tuple[str, int, int, int]]:
    """(type, start, end, pattern) of all proposed spans; spans may overlap."""
    out = []
    low = text.lower()
    if "@" in low or "chiocciola" in low or "at)" in low or "[at" in low or "arroba" in low or " at " in low:
        for m in EMAIL.finditer(text):
            s = m.group()
            if "@" in s or re.search(r"[(\[]\s?(?:at|chiocciola)|chiocciola|arroba", s, re.I):
                out.append(("email", m.start(), m.end(), 0))
    if NUMBERS.search(text):
        for m in PHONE.finditer(text):
            a = m.start() + (len(m.group()) - len(m.group().lstrip(" .-")))
            if 6 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", a, m.end(), 0))
        out += [("id_number", m.start(), m.end(), int(m.lastgroup[1:])) for m in ANY_IDENTITY.finditer(text)]
    for k, p in enumerate(ADDRESS):
        if any(x in low for x in GERMAN_PARTS) and GERMAN.search(text) if k == 4 else any(x in low for x in STREET_PARTS[k]):
            out += [("address", m.start(), m.end(), k + 1) for m in p.finditer(text) if k < 4 or GERMAN.search(m.group())]
    out += [("name", a, b, 0) for a, b in name_spans(text, given)]
    return out


def begin(text: str, a: int, back: int) -> int:
    """Start of the context before a span: the line's or the sentence's; a short word with a full stop ends none."""
    low = max(0, a - back)
    at = max(low, text.rfind("\n", low, a) + 1)
    dot = text.rfind(". ", at, a)
    while dot >= 0:
        if dot - at >= 4 and " " not in text[dot - 4 : dot]:
            return dot + 2
        dot = text.rfind(". ", at, dot)
    return at


def features(text: str, kind: str, a: int, b: int, pattern: int, given: frozenset) -> list[float]:
    """Format of a span and the classes of the words around it."""
    s = text[a:b]
    digits = sum(c.isdigit() for c in s)
    left = [w.lower() for w in WORDS.findall(text[begin(text, a, 60) : a])][-6:]
    stop = text.find("\n", b)
    right = [w.lower() for w in WORDS.findall(text[b : min(b + 30, stop if stop >= 0 else len(text))])][:3]
    last = CLASS.get(left[-1], 0) if left else 0
    around = 0
    for w in left:
        around |= CLASS.get(w, 0)
    after = 0
    for w in right:
        after |= CLASS.get(w, 0)
    first = fold(re.split(r"[\s,_.]+", s)[0]) if kind == "name" else ""
    row = [TYPES.index(kind), pattern, len(s), digits, sum(c.isupper() for c in s), s.count(" "), s.count("."), s.count("-"), s.count("/"), "@" in s, s[:1] == "+" or s[:2] == "(+", s[:2] == "00", s[:1] == "(", s[:1] == "0"]
    row += [len(re.split(r"[ ./-]+", s.strip("+() "))), first in given, len(first) == 1, any(fold(w) in given for w in re.split(r"[\s,_]+", s)) if kind == "name" else False, s.isupper(), s.islower()]
    row += [bool(re.fullmatch(r"(?:19|20)\d\d-\d{6}-\d\d", s)), bool(re.fullmatch(r"\d{4}\.\d{4}", s)), bool(re.fullmatch(r"\d{1,2}\.\d{1,2}\.\d{1,3}", s)), bool(re.fullmatch(r"(?:19|20)\d\d[-/](?:19|20)\d\d|\d\d[./-]\d\d[./-]\d{4}|\d{4}[./-]\d\d[./-]\d\d", s))]
    row += [a == 0 or text[a - 1] == "\n", text[max(0, a - 2) : a] == "| ", text[b : b + 2] == " <", a == 0 and b == len(text.strip()), bool(LEADS.search(text[max(0, a - 40) : a])), bool(TITLE.search(text[max(0, a - 12) : a]))]
    for bits in (last, around, after):
        row += [bits >> k & 1 for k in range(N_CLASSES)]
    return [float(v) for v in row]


def clear_label(text: str, kind: str, a: int, b: int, pattern: int, given: frozenset, field: bool) -> int | None:
    """1 or 0 where the context of a span leaves no doubt, else None. Training uses these spans only."""
    s = text[a:b]
    left = text[begin(text, a, 30) : a].lower()
    words = WORDS.findall(left)
    last = words[-1] if words else ""
    cls = CLASS.get(last, 0)
    is_ = lambda name: cls >> list(NEAR_WORDS).index(name) & 1
    if kind == "email":
        if NO_MAIL.search(s) or NO_MAIL_BEFORE.search(left) or NO_MAIL_AFTER.match(text[b : b + 2]):
            return 0
        return 1 if re.search(r"@|chiocciola|[(\[]at", s, re.I) and re.search(r"\.\w{2,}$|punto|dot", s, re.I) else None
    if re.fullmatch(r"(?:19|20)\d\d[-/](?:19|20)\d\d|\d\d[./-]\d\d[./-]\d{4}|\d{4}[./-]\d\d[./-]\d\d|(?:19|20)\d\d-\d{6}-\d\d|\d{4}\.\d{4}|\d{1,2}\.\d{1,2}\.\d{1,3}", s):
        return 0
    if kind == "phone":
        if is_("order"):
            return 0
        if is_("identity") or re.search(r"(?:n[°.o]\.?|id|cf) $", left):
            return 0
        if s.startswith(("+", "(+", "00")) or is_("contact") or re.search(r"tel\.? $|@\S+ [-–/] (?:tel\.? )?$", left) or (field and a < 12):
            return 1
        if re.fullmatch(r"\d{5}", s):
            return 0
        return None
    if kind == "id_number":
        if is_("order"):
            return 0
        if pattern >= 9 and (is_("contact") or s.startswith("0") and not is_("identity") or re.search(r"\+\d+ $|tel\.? $", left) or field):
            return 0
        if is_("identity") or re.search(r"(?:n[°.o]\.?|id|cf) $", left) or pattern <= 3:
            return 1
        return None
    if kind == "address":
        if COURSE.match(s) or (is_("thing") or is_("order")) and not AT_HOME.search(s):
            return 0
        return 1 if AT_HOME.search(s) or is_("home") or GERMAN.search(s) or re.match(r"(?:via|viale|v\.le|piazza|rue|calle|c/|\d)", s, re.I) else None
    if is_("thing") and not any(fold(w) in given for w in re.split(r"[\s,_]+", s)):
        return 0
    if re.search(r"(?:progett|project|proyect|projet|projekt|sede|site|modul|laborator|fornitor|vendor|schema|bando|reparto)\w* (?:di |de )?$", left):
        return 0
    if LEADS.search(left) or TITLE.search(left) or re.search(r"\b(?:nome|name|nom|nombre)\W*$", left) or text[b : b + 2] == " <":
        return 1
    first = fold(re.split(r"[\s,_.]+", s)[0])
    return 1 if first in given and len(s.split()) > 1 else None


def thresholds(kinds: np.ndarray, p: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """For each type the threshold with the best F-measure on held-out spans, nearest to the default one."""
    found = {}
    for k, kind in enumerate(TYPES):
        own, truth = p[kinds == k], y[kinds == k] > 0
        found[kind] = THRESHOLD
        if min(truth.sum(), (~truth).sum()) >= HELD_OUT:
            steps = np.linspace(*BOUNDS, 61)
            f = [2 * (truth & (own >= t)).sum() / max(1, truth.sum() + (own >= t).sum()) for t in steps]
            found[kind] = float(min(steps[np.array(f) >= max(f) - 1e-12], key=lambda t: abs(t - THRESHOLD)))
    return found


def trained(texts: list[tuple[str, bool]], given: frozenset) -> Trees:
    """Trees fitted on the spans of clear context in four fifths of the texts, calibrated and given thresholds on the rest."""
    rows, marks, held = [], [], []
    for k, (text, field) in enumerate(texts):
        for kind, a, b, pattern in candidates(text, given):
            y = clear_label(text, kind, a, b, pattern, given, field)
            if y is not None:
                rows.append(features(text, kind, a, b, pattern, given))
                marks.append(y)
                held.append(k % 5 == 0)
    for kind in TYPES:  # so that even an empty sample gives a model: a proposed span is right unless its words say else
        base = [float(TYPES.index(kind))] + [0.0] * 29 + [0.0] * 3 * N_CLASSES
        bad = list(base)
        order = list(NEAR_WORDS).index("order")
        bad[30 + order] = bad[30 + N_CLASSES + order] = 1.0
        rows += [base] * 6 + [bad] * 6
        marks += [1] * 6 + [0] * 6
        held += [False] * 12
    x, y, out = np.array(rows), np.array(marks, float), np.array(held)
    model = Trees().fit(x[~out], y[~out])
    if out.sum() > 50 and 0 < y[out].mean() < 1:
        model.calibrate(x[out], y[out])
    model.thresholds = thresholds(x[out][:, 0], model.probability(x[out]), y[out]) if out.any() else dict.fromkeys(TYPES, THRESHOLD)
    return model


#: Forms of order and version numbers, dates and spans of years; the exact check after the trees.
NO_CASE = re.compile(r"(?:19|20)\d\d[-/](?:19|20)\d\d|\d\d[./-]\d\d[./-]\d{4}|\d{4}[./-]\d\d[./-]\d\d|(?:19|20)\d\d-\d{6}-\d\d|\d{4}\.\d{4}|\d{1,2}\.\d{1,2}\.\d{1,3}")
RANK = {"email": 5, "address": 4, "id_number": 3, "phone": 2, "name": 1}


def select(text: str, spans: list[tuple[str, int, int, int]], p: np.ndarray, least: dict[str, float] | None = None) -> list[tuple[str, int, int]]:
    """Spans over their type's threshold without overlaps: the better type, then the longer, then the more likely one first."""
    kept: list[tuple[str, int, int]] = []
    order = sorted((k for k in range(len(spans)) if p[k] >= (least[spans[k][0]] if least else THRESHOLD)), key=lambda k: (-(RANK[spans[k][0]] if spans[k][0] in ("email", "address") else 3), -round(float(p[k]), 2) if spans[k][0] in ("phone", "id_number") else 0, -(spans[k][2] - spans[k][1]), -float(p[k]), spans[k][1]))
    for k in order:
        kind, a, b, _ = spans[k]
        if kind in ("phone", "id_number") and NO_CASE.fullmatch(text[a:b]):
            continue
        if all(b <= x or a >= y for _, x, y in kept):
            kept.append((kind, a, b))
    return sorted(kept, key=lambda s: s[1])


def places(hits: DataFrame, raw: DataFrame) -> DataFrame:
    """place, row_id, text of the three columns that are searched."""
    parts = [hits.select(F.lit("content").alias("place"), F.col("hit_id").alias("row_id"), F.col("content").alias("text")), *[raw.select(F.lit(c).alias("place"), F.col("raw_id").alias("row_id"), F.col(c).alias("text")) for c in ("email", "phone")]]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("trim(text) <> ''")


def model_for(rows: DataFrame, names: DataFrame) -> tuple[Trees, frozenset]:
    """The model, fitted on the texts with the least hashes: a bounded sample that no order of rows changes."""
    given = given_names(names.where("name is not null").distinct())
    sample: list[tuple[str, bool]] = []
    for r in rows.groupBy("place").count().collect():  # three places
        most = SAMPLE_TEXTS if r.place == "content" else SAMPLE_TEXTS // 6
        share = min(1.0, 1.3 * most / max(1, r["count"]) + 0.001)
        order = F.pmod(F.xxhash64("place", "row_id"), F.lit(1_000_000))
        drawn = rows.where((F.col("place") == r.place) & (order < math.ceil(share * 1_000_000)))
        sample += [(x.text, r.place != "content") for x in drawn.select("text", order.alias("o"), "row_id").orderBy("o", "row_id", "text").limit(most).collect()]
    sample.sort()
    return trained(sample, given), given


def scanned(rows: DataFrame, names: DataFrame, redact: bool = False) -> DataFrame:
    """place, row_id, pii_type, pii_text of every span; with redact the text with placeholders instead."""
    sent = rows.sparkSession.sparkContext.broadcast(model_for(rows, names))

    def run(batches):
        model, given = sent.value
        for part in batches:
            texts = part.text.tolist()
            spans = [candidates(t, given) for t in texts]
            x = [features(t, *s, given) for t, found in zip(texts, spans) for s in found]
            p = model.probability(np.array(x)) if x else np.empty(0)
            out, at = [], 0
            for place, i, t, found in zip(part.place, part.row_id, texts, spans):
                kept = select(t, found, p[at : at + len(found)], model.thresholds)
                at += len(found)
                if redact:
                    shown, end = [], 0
                    for kind, a, b in kept:
                        shown += [t[end:a], f"[{kind.upper()}]"]
                        end = b
                    out.append((place, i, "".join([*shown, t[end:]])))
                else:
                    out += [(place, i, kind, v) for kind, v in dict.fromkeys((k, t[a:b]) for k, a, b in kept)]
            yield pd.DataFrame(out, columns=["place", "row_id", "text"] if redact else ["place", "row_id", "pii_type", "pii_text"])

    return rows.mapInPandas(run, "place string, row_id bigint, text string" if redact else "place string, row_id bigint, pii_type string, pii_text string")


def _input(spark, sf_dir: str):
    hits = common.table(spark, sf_dir, "hits")
    raw = common.table(spark, sf_dir, "llm_extraction_raw")
    return places(common.spread(hits.select("hit_id", "content"), 4 * spark.sparkContext.defaultParallelism), raw.select("raw_id", "email", "phone")), hits.select(F.col("full_name").alias("name"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    return scanned(*_input(spark, sf_dir))


def p6_redacted(spark, sf_dir: str) -> DataFrame:
    """place, row_id, text with [TYPE] in the places of what was found."""
    return scanned(*_input(spark, sf_dir), redact=True)
