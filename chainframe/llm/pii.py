"""Personal data by candidate gradient boosting (DataFrame functions only).

High-recall generators propose spans that may overlap.  Fixed rules accept the
four base kinds; every other candidate is scored by boosted trees over its
format and its context, and calibrated thresholds (one per generator) select
the spans to redact.  The trees are fitted once per process, on the driver, on
``TRAINING_ROWS`` generated examples and become one Column expression.

Offsets count code points, ends are exclusive.  Defined cases: a null or empty
text has no spans; a text may be of any length, the patterns take time in
proportion to it; equal rows get equal results; of an added span and a base
span that overlap the base one stays; an empty table gives an empty result.
Only the id and text columns are read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, threshold_for_precision
from .common import let

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("phone_local", "national_id", "iban", "secret", "email_masked")
KINDS = BASE_KINDS + ADDED_KINDS

# The patterns below find what the plain ones find, leftmost and non-overlapping.  Possessive repeats and a
# start that is either a run's beginning or the previous match's end keep them linear on long texts.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

#: Generators of the added kinds: what must occur in a text at all, and the pattern.
GENERATORS: dict[str, tuple[str, str]] = {
    "phone_local": ("[0-9]", r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])"),
    "national_id": ("[0-9]", r"(?<![0-9A-Za-z.-])[0-9]{3}[\x20-]?[0-9]{2}[\x20-]?[0-9]{4}(?![0-9A-Za-z.-])"),
    "iban": ("[A-Z]{2}[0-9]{2}", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    "secret": ("[A-Za-z0-9_-]{16}", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}(?![A-Za-z0-9_-])"),
    "email_masked": (r"(?i)[(\[]\s?at\s?[)\]]", r"(?i)[a-z0-9._%+-]{1,64}\s?[(\[]\s?at\s?[)\]]\s?[a-z0-9-]{1,63}(?:\s?[(\[]\s?dot\s?[)\]]\s?[a-z0-9-]{1,63}|\.[a-z0-9-]{1,63})+"),
}
CONTEXT_CHARS = 24
CONTEXTS = (
    r"(?i)\b(?:tel|telephone|phone|call|mobile|cell|fax|t[eé]l[eé]fono?|telefon|appel\w*|handy)\b",
    r"(?i)\b(?:ssn|social|security|national|passport|tax|id|insee|dni)\b",
    r"(?i)\b(?:iban|bank|account|konto|cuenta|compte)\b",
    r"(?i)(?:token|secret|api.?key|access.?key|passw\w*|pwd|private.?key|bearer)",
    r"""(?i)[=:]\s?["']?$""",
)
AFTER_CHARS = 12
#: What may follow: an extension, a unit or currency, more of a longer number or word, a closing quote.
AFTERS = (
    r"(?i)^\s?(?:ext|x|app|poste|int)\b\.?\s?[0-9]",
    r"(?i)^\s?(?:%|€|\$|£|(?:eur|usd|gbp|chf|kg|g|km|m|cm|mm|ml|l|h|min|ms|mb|gb|items?|units?|pieces|stück|pages?|people|euros?|dollars?)\b)",
    r"^[-/.][0-9A-Za-z]",
    r"""^["']""",
)
#: Format patterns tested on the span itself.
FORMATS = (r"^\(?[0-9]", r"\(", r"[0-9]-[0-9]", r"[0-9]\x20[0-9]", r"[0-9]\.[0-9]", r"[a-z]", r"[A-Z]", r"[_-]", r"^[0-9a-f]+$", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", r"^(?:19|20)[0-9]{2}[\x20.-]")
N_FEATURES = 3 + len(FORMATS) + len(CONTEXTS) + len(AFTERS)

#: Bounds of the fit: generated examples per generator and their seed.
TRAINING_ROWS = 1200
TRAINING_SEED = 20240229
PRECISION = 0.98

_SPANS = "array<struct<s:int,e:int,m:string>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def located(text: Column, pattern: str) -> Column:
    """All matches with their offsets: the gaps between them give the positions."""

    def fold(m: Column, gaps: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["pos"] + F.length(gaps[x["i"]])
            end = start + F.length(x["m"])
            return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m")))).alias("out"))

        indexed = F.transform(m, lambda x, i: F.struct(x.alias("m"), i.alias("i")))
        return F.aggregate(indexed, F.struct(F.lit(0).alias("pos"), _none().alias("out")), step, lambda acc: acc["out"])

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(matches, lambda m: F.when(F.size(m) == 0, _none()).otherwise(let(F.split(text, pattern, -1), lambda gaps: fold(m, gaps))))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = F.translate(F.lit("0123456789"), "0123456789", "0246813579")
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.substring(doubled, d.cast("int") + 1, F.lit(1)).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _card(m: Column) -> Column:
    return let(_digits(m), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False))


def base_spans(text: Column) -> dict[str, Column]:
    """The four kinds that fixed rules decide."""
    when = lambda cond, pattern: F.when(cond, located(text, pattern)).otherwise(_none())
    has_digit = text.rlike("[0-9]")
    return {
        "email": when(F.contains(text, F.lit("@")), EMAIL),
        "ip": F.filter(when(has_digit, IP), lambda x: x["m"].rlike(OCTETS)),
        "card": F.filter(when(has_digit, CARD), lambda x: _card(x["m"])),
        "phone": F.filter(when(F.contains(text, F.lit("+")), PHONE), lambda x: F.length(_digits(x["m"])).between(10, 15)),
    }


def _features(span: Column, before: Column, after: Column) -> Column:
    distinct = F.size(F.array_distinct(F.split(span, "")))
    values = [F.length(span), F.length(_digits(span)), distinct]
    values += [span.rlike(p).cast("int") for p in FORMATS]
    values += [before.rlike(p).cast("int") for p in CONTEXTS]
    values += [after.rlike(p).cast("int") for p in AFTERS]
    return F.array(*values)


def features_of(span: str, before: str, after: str) -> list[int]:
    """The same features on the driver, for the fit."""
    return [len(span), sum(c in "0123456789" for c in span), len(set(span)), *(int(bool(re.search(p, span))) for p in FORMATS), *(int(bool(re.search(p, before))) for p in CONTEXTS), *(int(bool(re.search(p, after))) for p in AFTERS)]


def _examples(kind: str, rng: random.Random, n: int) -> tuple[list[list[int]], list[int]]:
    """Generated spans of one generator with and without personal data."""
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("aeinorstlh") for _ in range(rng.randint(2, 8)))
    upper = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(k))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-") for _ in range(k))
    plain = lambda: (word() + " " + word() + rng.choice([", ", " ", ". ", ": "]))[-CONTEXT_CHARS:]
    cued = lambda *cues: (word() + " " + rng.choice(cues) + rng.choice([": ", " ", " = ", ' = "', " is "]))[-CONTEXT_CHARS:]
    phone_cues, id_cues, bank_cues = ("tel", "phone", "call", "mobile", "fax", "Telefon"), ("SSN", "social security", "national id", "tax id", "passport"), ("IBAN", "bank account", "Konto", "account")
    secret_cues = ("token", "secret", "api_key", "password", "access-key", "private key")
    sep = lambda: rng.choice("-. ")
    made: dict[str, tuple] = {
        "phone_local": (
            lambda: (f"({digits(3)}) {digits(3)}-{digits(4)}", rng.choice([plain, lambda: cued(*phone_cues)])()) if rng.random() < 0.5 else (digits(3) + (s := rng.choice("-.")) + digits(3) + s + digits(4), rng.choice([plain, lambda: cued(*phone_cues)])()) if rng.random() < 0.6 else (digits(rng.randint(2, 4)) + sep() + digits(3) + sep() + digits(4), cued(*phone_cues)),
            lambda: (digits(rng.randint(2, 4)) + " " + digits(rng.randint(3, 4)) + " " + digits(rng.randint(3, 4)), plain()) if rng.random() < 0.6 else (digits(4) + "-" + digits(4) + "-" + digits(4), plain()) if rng.random() < 0.5 else (digits(rng.randint(2, 3)) + "." + digits(3) + "." + digits(3), plain()),
        ),
        "national_id": (
            lambda: (digits(3) + "-" + digits(2) + "-" + digits(4), rng.choice([plain, lambda: cued(*id_cues)])()) if rng.random() < 0.6 else (digits(3) + (s := rng.choice(["", " "])) + digits(2) + s + digits(4), cued(*id_cues)),
            lambda: (digits(3) + (s := rng.choice(["", " "])) + digits(2) + s + digits(4), rng.choice([plain, lambda: cued("order", "invoice", "page", "item")])()),
        ),
        "iban": (
            lambda: (upper(2) + digits(2) + (s := rng.choice(["", " "])) + s.join(digits(4) for _ in range(rng.randint(3, 5))) + s + digits(2), rng.choice([plain, lambda: cued(*bank_cues)])()),
            lambda: (upper(2) + digits(2) + (s := rng.choice(["", " "])) + s.join(upper(4) for _ in range(rng.randint(2, 6))), plain()) if rng.random() < 0.7 else (upper(2) + digits(2) + digits(4) + digits(4), cued("model", "part", "serial")),
        ),
        "secret": (
            lambda: (rng.choice([hexes, mixed])(rng.randint(20, 64)), cued(*secret_cues)),
            lambda: (rng.choice([hexes, mixed, digits])(rng.randint(16, 64)), plain()) if rng.random() < 0.4 else ("".join(word() for _ in range(6))[: rng.randint(16, 40)].ljust(16, "e"), rng.choice([plain, lambda: cued(*secret_cues)])()) if rng.random() < 0.6 else (rng.choice("-_").join(word() for _ in range(7)), plain()) if rng.random() < 0.8 else (digits(rng.randint(16, 19)), cued("order", "number")),
        ),
        "email_masked": (lambda: (f"{word()} (at) {word()} (dot) com", plain()) if rng.random() < 0.5 else (f"{word()}[at]{word()}.org", plain()), lambda: (f"{word()} (at) {word()}.{word()}{word()}{word()}", plain()) if rng.random() < 0.2 else (f"{word()}(at){word()}.5", plain())),
    }
    ends = (". ", ", ", " ", "\n", " and ", "; ", ")")
    yes = lambda: rng.choice([*ends, " ext 12", " x 204", '"', "'"])
    no = lambda: rng.choice([*ends, " EUR", " kg", "%", " items", " km", f"-{digits(3)}", f"/{word()}", f".{digits(2)}"])
    x, y = [], []
    for i in range(n):
        span, before = made[kind][i % 2]()
        x.append(features_of(span, before, (no if i % 2 else yes)()[:AFTER_CHARS]))
        y.append(1 - i % 2)
    return x, y


@lru_cache(maxsize=1)
def models() -> dict[str, tuple[BoostedTrees, float]]:
    """Per generator the fitted trees and the calibrated threshold, on a held-out third."""
    fitted = {}
    for kind in GENERATORS:
        x, y = (np.array(v) for v in _examples(kind, random.Random(f"{TRAINING_SEED}:{kind}"), TRAINING_ROWS))
        held = np.arange(len(y)) % 6 >= 4
        trees = BoostedTrees(rounds=12).fit(x[~held], y[~held])
        fitted[kind] = (trees, threshold_for_precision(trees.scores(x[held]), y[held], PRECISION))
    return fitted


def added_spans(text: Column) -> dict[str, Column]:
    """Candidates of every generator that the trees accept."""

    def accepts(trees: BoostedTrees, cut: float) -> Callable[[Column], Column]:
        def accepted(x: Column) -> Column:
            start = F.greatest(x["s"] - CONTEXT_CHARS, F.lit(0))
            before, after = F.substring(text, start + 1, x["s"] - start), F.substring(text, x["e"] + 1, F.lit(AFTER_CHARS))
            return let(_features(x["m"], before, after), lambda f: trees.column(lambda i: f[i]) > cut)

        return accepted

    return {kind: F.filter(F.when(text.rlike(needs), located(text, pattern)).otherwise(_none()), accepts(*models()[kind])) for kind, (needs, pattern) in GENERATORS.items()}


_SORTED = "array<struct<s:int,k:int,e:int>>"


def _tagged(kinds: dict[str, Column]) -> Column:
    def tag(name: str) -> Callable[[Column], Column]:
        return lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(name)).alias("k"), x["e"].alias("e"))

    return F.concat(F.array().cast(_SORTED), *(F.transform(found, tag(name)) for name, found in kinds.items()))


def spans(text: Column) -> Column:
    """struct<base, all>: spans (start, kind number, end), sorted by start and kind.

    An added span that overlaps a base span is left out: the base one covers the place.
    """
    t = F.coalesce(text, F.lit(""))

    def combine(b: Column, a: Column) -> Column:
        free = F.filter(a, lambda x: ~F.exists(b, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
        return F.struct(F.array_sort(b).alias("base"), F.array_sort(F.concat(b, free)).alias("all"))

    return let(_tagged(base_spans(t)), lambda b: let(_tagged(added_spans(t)), lambda a: combine(b, a)))


def _named(found: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(found, lambda x: F.concat(names[x["k"]], F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))))


def find_pii(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``found`` (base and all spans)."""
    return documents.select(F.col(id_col), spans(F.col(text_col)).alias("found"))


def redacted(text: Column) -> Column:
    """The text with every span replaced by ``[KIND]``; overlapping spans become one."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def rebuild(t: Column, found: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            fresh = F.concat(acc["out"], F.array(F.substring(t, acc["pos"] + 1, x["s"] - acc["pos"]), names[x["k"]]))
            return F.when(x["s"] >= acc["pos"], F.struct(x["e"].alias("pos"), fresh.alias("out"))).otherwise(F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), acc["out"].alias("out")))

        start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(found, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["pos"] + 1, F.length(t))))

    return let(spans(text)["all"], lambda found: F.when(F.size(found) == 0, text).otherwise(rebuild(text, found)))


def redact(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns unchanged but the text."""
    return documents.withColumn(text_col, redacted(F.col(text_col)))


def digest(documents: DataFrame) -> DataFrame:
    found = find_pii(documents)
    base = F.col("found")["base"]
    count = lambda k: F.size(F.filter(base, lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(_named(base), 256).alias("base_sha256"), _named(F.col("found")["all"]).alias("spans"))
