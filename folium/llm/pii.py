"""Personal data by weak supervision.

Candidate spans come from the four base patterns and from looser ones: local phone numbers, social security numbers, IBANs,
spelled-out mail addresses, persons and street addresses. Labelers vote on each: the pattern with its check (regex: Luhn, the IBAN's
remainder, number ranges, titles), lists of names, places, prefixes and endings (gazetteer), the words before it (context), and its
neighbourhood and repetitions (shape). Expectation-maximisation over the histogram of votes estimates how far each labeler is to be
trusted; base spans that pass their check are known to be personal data and candidates that fail a check are known not to be, so that
the classes cannot change places. A labeler that abstains says nothing, and a loose kind's prior stays below one half: a span on which
all abstain is not added. A logistic classifier on the span's own features (kind, votes, length, digits, what stands before and
after) is then trained on the posteriors. Base spans always stay; looser spans are added where the classifier says so, without overlaps.

The corpus is counted by Spark; only the histogram reaches the driver, whose size the kinds, votes and features bound.

Defined results: a null or empty text has no spans; repeated rows each get a result; an empty table gives an empty one and
a classifier that adds nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import table, text_of
from folium.llm.spans import clear_of, digest, disjoint, find, masked

KINDS = ("email", "ip", "card", "phone")
LOOSE = ("phone_local", "ssn", "iban", "email_spelled", "person", "address")
# The base patterns, with possessive runs from a run's first character: the same matches, in linear time.
LOCAL = r"[A-Za-z0-9._%+-]"
STREET = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Way|Place|Square|Terrace)"
RUE = r"(?:rue|avenue|boulevard|place|calle|avenida|plaza|paseo)"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=(?:[0-9][\x20-]?){11}[0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "phone_local": r"(?<![0-9A-Za-z+.)-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.][0-9]{4}(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "email_spelled": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?[\(\[]at[\)\]]\x20?[A-Za-z0-9-]++\x20?(?:\.|[\(\[]dot[\)\]])\x20?[A-Za-z]{2,}+",
    "person": r"(?<![\p{L}\p{N}_'-])\p{Lu}\p{Ll}++(?:\x20\p{Lu}\.)?(?:\x20\p{Lu}\p{Ll}++){1,2}(?![\p{L}\p{N}_'-])",
    "address": rf"(?<![\p{{L}}\p{{N}}])(?:[0-9]{{1,5}}[a-z]?\x20(?:\p{{Lu}}\p{{Ll}}*+\.?\x20){{1,3}}{STREET}(?![\p{{L}}])|\p{{Lu}}\p{{Ll}}*?(?:stra(?:ß|ss)e|weg|platz|allee|gasse)\x20[0-9]{{1,4}}[a-z]?(?![\p{{L}}\p{{N}}])|[0-9]{{1,4}},?\x20{RUE}\x20(?:\p{{Ll}}{{1,3}}\x20){{0,2}}\p{{Lu}}\p{{Ll}}++|(?i:{RUE})\x20(?:\p{{Ll}}{{1,3}}\x20){{0,2}}\p{{Lu}}\p{{Ll}}++,?\x20[0-9]{{1,4}}(?![\p{{N}}]))",
}
GOOD_WORDS = r"(?i)(?:mail|contact|call|phone|tel|mobile|fax|card|visa|iban|account|address|host|login|reach|write|ssn|social|konto|correo|courriel)[^\p{L}\n]{0,12}\p{L}{0,10}[^\p{L}\n]{0,6}$"
PERSON_WORDS = r"(?i)(?<![\p{L}])(?:mr|mrs|ms|miss|dr|prof|herr|frau|mme|monsieur|madame|señor|señora|sr|sra|name|named|dear|hello|hi|signed|sincerely|regards|author|attn|contact|patient|employee|customer|von|by)[.:,]?\x20{1,2}$"
ADDRESS_WORDS = r"(?i)(?<![\p{L}])(?:lives?|living|address|resides?|located|home|house|at|ship(?:ped)?\x20to|wohnt|in\x20der|adresse|habite|domicilio|vive\x20en)[.:,]?\x20{1,2}(?:at\x20|in\x20|to\x20|is\x20|au\x20)?$"
BAD_WORDS = r"(?i)(?:version|release|order|invoice|isbn|serial|page|figure|section|chapter|build|part no|model|item)[^\p{L}\n]{0,12}$"
#: A sentence's or line's begin before, and a capitalised word after: titles and headings rather than names.
TITLE = r"(?i)(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20$"
#: Endings of the domain names, and country codes, that the gazetteer knows.
ENDINGS = r"(?i)\.(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|us|eu|it|nl|ch|at)$"
COUNTRIES = r"^(?:DE|FR|ES|GB|IT|NL|BE|AT|CH|PT|IE|LU|PL|SE|DK|NO|FI)"
#: Common names of four languages, places, and capitalised words that are neither.
GIVEN = (
    "Mary Maria Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emma Olivia Anna Laura Julia Sophie Claire Camille Isabelle Nathalie Carmen Lucia Elena Sofia Ana Ursula Monika Petra Sabine "
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Mark Paul Peter George Jack Hans Klaus Wolfgang Stefan Andreas Jürgen Pierre Jean Michel Philippe Antoine José Juan Carlos Luis Miguel Antonio Javier Pablo"
).split()
SURNAMES = (
    "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Thomas Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Walker "
    "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Dubois Bernard Durand Leroy Moreau Laurent Lefebvre Roux Fournier Girard Sanchez Perez Gomez Fernandez Diaz Torres Ruiz Alvarez Romero"
).split()
PLACES = "London Paris Berlin Madrid Boston Chicago Seattle Denver Dallas Houston Austin Portland Atlanta Miami Toronto Dublin Vienna Wien Zürich Hamburg München Köln Frankfurt Stuttgart Lyon Marseille Toulouse Nice Barcelona Valencia Sevilla Bilbao".split()
NEITHER = (
    "The This That These Those And But For From With Without Chapter Section Figure Table Page Part General Public License Apache Foundation Software Version Copyright All Rights Reserved University Press Company Limited "
    "January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday North South East West New Great United States Kingdom National International Street Road Terms Service"
).split()
_whole = lambda words: "(?:" + "|".join(words) + ")"
NAME_FIRST, NAME_LAST, NO_NAME = rf"^{_whole(GIVEN)}(?![\p{{L}}])", rf"(?<![\p{{L}}]){_whole(SURNAMES)}$", rf"(?<![\p{{L}}]){_whole(NEITHER + PLACES)}(?![\p{{L}}])"
PLACE_AFTER = rf"^,?\x20(?:[0-9]{{5}}\x20)?{_whole(PLACES)}(?![\p{{L}}])|^,?\x20[A-Z]{{2}}\x20[0-9]{{5}}|^,\x20[0-9]{{5}}"
ROUNDS, STEPS = 40, 300
KEEP = 0.5
#: What a loose kind's share of personal data is taken for at most before anyone votes.
MOST_PRIOR = 0.4
LABELERS = 4


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(places, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def iban_check(hit: Column) -> Column:
    """Whether an IBAN leaves the remainder 1 modulo 97, its first four characters at the end and letters as 10 to 35."""
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda c: F.position(c, F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")) - 1
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(value(c) > 9, a * 100 + value(c)).otherwise(a * 10 + value(c)) % 97) == 1


def valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")) < 4) & F.forall(F.split(hit, r"\."), lambda p: F.coalesce(F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 4).cast("int"), F.lit(999)) <= 255)
    if kind == "card":
        return F.length(_digits(hit)).between(12, 19) & luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _regex(kind: str, hit: Column, before: Column) -> Column:
    d = _digits(hit)
    if kind in KINDS:
        return _vote(valid(kind, hit), ~valid(kind, hit))
    if kind == "phone_local":
        return _vote(d.rlike("^[2-9][0-8][0-9][2-9]"), d.rlike("^[01]|^...[01]"))
    if kind == "ssn":
        good = d.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")
        return _vote(good, ~good)
    if kind == "iban":
        return _vote(iban_check(hit), ~iban_check(hit))
    if kind == "person":
        return _vote(before.rlike(TITLE) | hit.rlike(r"\x20\p{Lu}\.\x20"), F.lit(False))
    return _vote(F.lit(True), F.lit(False))


def _gazetteer(kind: str, hit: Column, after: Column) -> Column:
    d = _digits(hit)
    if kind == "email":
        return _vote(hit.rlike(ENDINGS), F.lit(False))
    if kind == "email_spelled":
        return _vote(hit.rlike(r"(?i)(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|us|eu|it|nl|ch|at)$"), F.lit(False))
    if kind == "ip":
        return _vote(~hit.rlike(r"^0*(?:0|127|255)\.") & hit.rlike(r"^[0-9]{1,3}\."), hit.rlike(r"^0+\."))
    if kind == "card":
        return _vote(d.rlike("^[3-6]"), d.rlike("^0"))
    if kind == "iban":
        return _vote(hit.rlike(COUNTRIES), ~hit.rlike(COUNTRIES))
    if kind == "ssn":
        return _vote(F.lit(False), d.rlike("^(?:000|666|9)|^...00|0000$"))
    if kind == "person":
        return _vote((hit.rlike(NAME_FIRST) | hit.rlike(NAME_LAST)) & ~hit.rlike(NO_NAME), hit.rlike(NO_NAME))
    if kind == "address":
        return _vote(after.rlike(PLACE_AFTER), F.lit(False))
    return _vote(d.rlike("^1?[2-9]"), d.rlike("^0{2}"))


def _context(kind: str, before: Column) -> Column:
    words = {"person": PERSON_WORDS, "address": ADDRESS_WORDS}.get(kind, GOOD_WORDS)
    return _vote(before.rlike(words), before.rlike(BAD_WORDS))


def _shape(kind: str, hit: Column, after: Column) -> Column:
    d = _digits(hit)
    if kind == "person":  # the same word again, or a row of capitalised words
        return _vote(F.lit(False), hit.rlike(r"(?i)(?<![\p{L}])(\p{L}++)\x20\1(?![\p{L}])") | after.rlike(r"^\x20\p{Lu}\p{Ll}+(?:[\x20.,\n]|$)"))
    return _vote(F.lit(False), (d.rlike(r"^(.)\1*$") | d.rlike("^0?123456789?|987654321?0?$")) & (F.length(d) > 0))


def _features(kind: str, hit: Column, before: Column, after: Column) -> list[Column]:
    length = F.length(hit)
    size = F.when(length < 9, 0).when(length < 14, 1).when(length < 22, 2).otherwise(3)
    digits = F.when(F.length(_digits(hit)) == 0, 0).when(F.length(_digits(hit)) * 2 < length, 1).otherwise(2)
    led = F.when(before.rlike(r"(?:^|\n)$"), 0).when(before.rlike(r"[:=,(\[]\x20?$"), 1).when(before.rlike(r"[.!?|]\x20*$"), 2).otherwise(3)
    followed = F.when(after.rlike(r"^(?:$|\n)"), 0).when(after.rlike(r"^[.,;:!?)\]]"), 1).otherwise(2)
    return [size, digits, led, followed]


def candidates(text: Column) -> Column:
    """All candidate spans: struct<start,end,kind,rank,ok,seen>; ``ok``: a base span that passes its check; ``seen``: kind, votes and features."""
    # Linear scans behind byte searches that most texts fail.
    digit = text.rlike("[0-9]")
    guards = {
        "email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": digit, "card": digit, "phone_local": digit, "ssn": digit, "iban": digit,
        "email_spelled": F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]")), "person": None, "address": digit,
    }

    def told(kind: str, rank: int) -> Column:
        def one(s: Column) -> Column:
            before = F.substring(text, F.greatest(s["start"] - 31, F.lit(1)), F.least(s["start"], F.lit(32)))
            after = F.substring(text, s["end"] + 1, F.lit(24))
            votes = [_regex(kind, s["hit"], before), _gazetteer(kind, s["hit"], after), _context(kind, before), _shape(kind, s["hit"], after)]
            seen = F.concat_ws("|", F.lit(kind), *[v.cast("string") for v in (*votes, *_features(kind, s["hit"], before, after))])
            return F.struct(s["start"], s["end"], F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), (valid(kind, s["hit"]) & F.lit(kind in KINDS)).alias("ok"), seen.alias("seen"))

        return F.transform(find(text, PATTERNS[kind], guards[kind]), one)

    return F.concat(*[told(k, i) for i, k in enumerate((*KINDS, *LOOSE))])


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS, known: np.ndarray | None = None, kind: np.ndarray | None = None, most_prior: float = 0.98) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM for independent labelers over distinct rows of votes (-1, 0, 1): posteriors, P(vote | class), prior of each kind.

    ``known`` holds the class of rows that are certain and NaN elsewhere; the prior of a ``kind`` is that of its uncertain rows. An
    abstention (0) counts for neither class.
    """
    n = votes.shape[1]
    known = np.full(len(votes), np.nan) if known is None else known
    kind = np.zeros(len(votes), int) if kind is None else kind
    open_ = np.isnan(known)
    post = np.where(open_, 1 / (1 + np.exp(-1.5 * votes.sum(axis=1))), known)
    table_, prior = np.zeros((2, n, 3)), np.full(kind.max() + 1, min(0.5, most_prior))
    for _ in range(rounds):
        for c, w in ((1, post * counts), (0, (1 - post) * counts)):
            for j in range(n):
                # A labeler starts out better than chance: pseudo-counts towards the vote that fits the class.
                base = np.array([0.5, 1.0, 2.0] if c else [2.0, 1.0, 0.5])
                got = np.bincount(votes[:, j] + 1, weights=w, minlength=3) + base
                table_[c, j] = got / got.sum()
        spoke = table_ / (table_[:, :, :1] + table_[:, :, 2:])  # of those votes that are none of abstention
        mass, held = np.bincount(kind[open_], weights=(post * counts)[open_], minlength=len(prior)), np.bincount(kind[open_], weights=counts[open_], minlength=len(prior))
        prior = np.clip((mass + 1) / (held + 2), 0.02, most_prior)
        odds = np.log(prior[kind] / (1 - prior[kind])) + sum(np.where(votes[:, j] != 0, np.log(spoke[1, j, votes[:, j] + 1] / spoke[0, j, votes[:, j] + 1]), 0) for j in range(n))
        post = np.where(open_, 1 / (1 + np.exp(-np.clip(odds, -30, 30))), known)
    return post, table_, prior


def _row(seen: str) -> tuple[str, list[int], list[int]]:
    kind, *rest = seen.split("|")
    return kind, [int(v) for v in rest[:LABELERS]], [int(v) for v in rest[LABELERS:]]


def _names(seen: str) -> list[str]:
    """The names of the features that a span has."""
    kind, votes, shape = _row(seen)
    return ["all", kind, *[f"vote{j}{v:+d}" for j, v in enumerate(votes) if v], *[f"shape{j}={v}" for j, v in enumerate(shape)]]


def fit(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """The classifier's weight of each feature, learned from all documents; empty where there is no candidate."""
    counted = docs.select(F.explode(candidates(text_of(text_col))["seen"]).alias("seen")).groupBy("seen").count()
    seen = sorted((r["seen"], r["count"]) for r in counted.collect())  # kinds x 3^4 votes x 144 shapes at most
    if not seen:
        return {}
    rows = [_row(k) for k, _ in seen]
    kinds = [*KINDS, *LOOSE]
    votes, counts = np.array([v for _, v, _ in rows]), np.array([c for _, c in seen], float)
    kind = np.array([kinds.index(k) for k, _, _ in rows])
    base = kind < len(KINDS)
    # What is certain: base spans, and all that fails a check.
    known = np.where(votes[:, 0] < 0, 0.0, np.where(base, 1.0, np.nan))
    post, _, _ = reliabilities(votes, counts, known=known, kind=kind, most_prior=MOST_PRIOR)
    names = sorted({n for k, _ in seen for n in _names(k)})
    spot = {n: i for i, n in enumerate(names)}
    x = np.zeros((len(seen), len(names)))
    for i, (k, _) in enumerate(seen):
        x[i, [spot[n] for n in _names(k)]] = 1
    # Each kind weighs alike, however often it is seen.
    weight = counts / np.bincount(kind, weights=counts, minlength=len(kinds))[kind] / len(set(kind.tolist()))
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - post)) + 1e-4 * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return {n: round(float(v), 9) for n, v in zip(names, w, strict=True)}


def probability(seen: Column, model: dict[str, float]) -> Column:
    """The classifier's probability of a candidate, from its kind, votes and features."""
    parts = F.split(seen, r"\|")
    score = F.lit(model.get("all", -9.0))
    for k in (*KINDS, *LOOSE):
        score = score + F.when(parts[0] == k, model.get(k, 0.0)).otherwise(0.0)
    for j in range(LABELERS):
        score = score + F.when(parts[1 + j] == "1", model.get(f"vote{j}+1", 0.0)).when(parts[1 + j] == "-1", model.get(f"vote{j}-1", 0.0)).otherwise(0.0)
    for j in range(4):
        for v in range(4):
            if f"shape{j}={v}" in model:
                score = score + F.when(parts[1 + LABELERS + j] == str(v), model[f"shape{j}={v}"]).otherwise(0.0)
    return 1 / (1 + F.exp(-score))


def detect(docs: DataFrame, model: dict[str, float], text_col: str = "text", out: str = "pii") -> DataFrame:
    """Adds ``<out>_base`` and ``<out>_added``: struct<start,end,kind,rank,...> arrays."""
    found = docs.withColumn(f"{out}_all", candidates(text_of(text_col)))
    found = found.withColumn(f"{out}_base", F.filter(f"{out}_all", lambda s: s["ok"]))
    loose = F.filter(f"{out}_all", lambda s: (s["rank"] >= len(KINDS)) & (probability(s["seen"], model) >= KEEP))
    return found.withColumn(f"{out}_added", disjoint(clear_of(loose, F.col(f"{out}_base")))).drop(f"{out}_all")


def redact(docs: DataFrame, model: dict[str, float], text_col: str = "text") -> DataFrame:
    """The documents with each personal span replaced by its kind, and all columns as they were."""
    own = "_pii"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    marked = detect(docs, model, text_col, own)
    hidden = F.when(F.col(text_col).isNull(), F.lit(None).cast("string")).otherwise(masked(F.col(text_col), F.concat(spans(f"{own}_base"), spans(f"{own}_added"))))
    return marked.withColumn(text_col, hidden).select(*docs.columns)


def spans(column: str) -> Column:
    return F.transform(column, lambda s: F.struct(s["start"], s["end"], s["kind"], s["rank"]))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = detect(docs, fit(docs))

    def count(k: str) -> Column:
        return F.size(F.filter("pii_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")

    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(digest(F.col("pii_base")), 256).alias("base_sha256"), digest(F.concat(spans("pii_base"), spans("pii_added"))).alias("spans"))


QUERIES = {"op3_pii": op3_pii}
SQL: dict[str, str] = {}
