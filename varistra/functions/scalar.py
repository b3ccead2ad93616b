"""Scalar expressions of the serving table: display names, bands, JSON lists, decoders, likelihoods and rankings.

All are Column functions; each null rule is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values: result classes that must match
CONSTRAINT_BANDS = ((0.35, "highly constrained"), (0.6, "constrained"), (1.0, "moderate"))
TIERS = ((0.9, "very high"), (0.75, "high"))
LOW_TIERS = ((0.1, "very low"), (0.25, "low"))
CALIBRATION = ((0.0, 0.1, 1.8), (0.1, 0.3, 15.6), (0.3, 0.5, 44.4), (0.5, 0.7, 69.6), (0.7, 0.9, 88.1), (0.9, 1.01, 96.7))
AMINO = "ACDEFGHIKLMNPQRSTVWY"
CODING_IMPACTS = ("HIGH", "MODERATE")
CODING_TERMS = ("missense", "frameshift", "stop", "splice", "inframe", "start_lost", "stop_lost")
CODING_DISPLAY_TERMS = ("missense", "frameshift", "stop", "splice", "inframe", "start lost", "stop lost")
CONSEQUENCE_BINS = {"Missense": "missense", "Nonsense": "nonsense_like", "Frameshift": "frameshift", "Splice Donor": "splice", "Splice Acceptor": "splice", "Synonymous": "synonymous"}
ACRONYMS = (("Cpg", "CpG"), ("Plddt", "pLDDT"), ("Cds", "CDS"), ("Utr", "UTR"), ("Ccre", "cCRE"), ("Iii", "III"), ("Ii", "II"))


def display_enum(c: Column, names: dict[str, str]) -> Column:
    """F1: the name of a known value, else underscores to spaces and a capital for each word; null stays null."""
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.try_element_at(known, c), F.initcap(F.replace(c, F.lit("_"), F.lit(" "))))


def band_below(c: Column, bands, above: str) -> Column:
    """the first band whose upper bound is over the value, else ``above``; null stays null."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for top, name in bands:
        out = out.when(c < top, name)
    return out.otherwise(above)


def frequency_band(c: Column) -> Column:
    """rarer than 1e-4 but seen, over 5 %, over 1 %; the order of the tests matters."""
    return F.when((c > 0) & (c < 1e-4), "ultra-rare").when(c > 0.05, "common").when(c > 0.01, "low-frequency")


def frequency_text(c: Column) -> Column:
    """null or 0 is not observed; under 1 % as one in n, else as a percentage."""
    return F.when(c.isNull() | (c == 0), "Not observed").when(c < 0.01, F.concat(F.lit("1 in "), F.format_number(F.round(1 / F.greatest(c, F.lit(1e-12))).cast("long"), 0))).otherwise(F.concat(F.round(c * 100, 1).cast("decimal(10,1)").cast("string"), F.lit("%")))


def after_last(c: Column, mark: str = ":") -> Column:
    """what stands after the last mark, the whole text without one."""
    return F.substring_index(c, mark, -1)


def list_items(c: Column, mark: str = ";", exclude: tuple[str, ...] = ()) -> Column:
    """trimmed non-empty items of a list in a text, without excluded ones (in lower case); null gives no items."""
    items = F.transform(F.split(F.coalesce(c, F.lit("")), mark), lambda x: F.trim(x))
    return F.filter(items, lambda x: (x != "") & ~F.lower(x).isin(*exclude) if exclude else x != "")


def list_json(c: Column, mark: str = ";", exclude: tuple[str, ...] = ()) -> Column:
    """F6 as JSON text."""
    return F.to_json(list_items(c, mark, exclude))


def domains(c: Column, deny: tuple[str, ...] = ()) -> Column:
    """``db:id,db:id`` as an array of structs without denied databases; parts without a colon are left out."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.instr(x, ":") > 0)
    pairs = F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("db"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("id")))
    return F.filter(pairs, lambda d: ~d["db"].isin(*deny)) if deny else pairs


def decode_class(c: Column, classes: list[str]) -> Column:
    """F8: the class at a zero-based place; null, negative or too large gives null."""
    return F.when((c >= 0) & (c < len(classes)), F.get(F.array(*map(F.lit, classes)), c.cast("int")))


def swap_classes() -> list[str]:
    return [f"{a}>{b}" for a in AMINO for b in AMINO if a != b]


def clamp01(c: Column, missing: float = 0.5) -> Column:
    """within 0 and 1, null as ``missing``."""
    return F.when(c.isNull(), missing).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def slug(c: Column, most: int = 60) -> Column:
    """lower case, other than letters and digits to one underscore, none at the ends, at most ``most`` long."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, most)


def keyword_class(c: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """the class of the first pattern that matches (any case)."""
    out = F.when(c.isNull(), other)
    for pattern, name in rules:
        out = out.when(F.lower(c).rlike(pattern), name)
    return out.otherwise(other)


def head_group(c: Column) -> Column:
    """The part of a name before its first underscore, in lower case."""
    return F.lower(F.substring_index(c, "_", 1))


def quartile_bin(c: Column) -> Column:
    """quarter of the unit range, NaN and null as bins of their own."""
    return F.when(c.isNull() | F.isnan(c), "missing").when(c < 0.25, "q1").when(c < 0.5, "q2").when(c < 0.75, "q3").otherwise("q4")


def bucket(c: Column, missing: str = "unknown") -> Column:
    """trimmed lower case; null or blank as ``missing``."""
    return F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit(missing))


def same(a: Column, b: Column, null_is_false: bool) -> Column:
    """equality; with a null on a side null, or false where asked."""
    return F.coalesce(a == b, F.lit(False)) if null_is_false else a == b


def calibration_text(c: Column) -> Column:
    """the half-open bin of a score in words; outside all bins empty."""
    out = F.when(c.isNull(), "")
    for lo, hi, rate in CALIBRATION:
        out = out.when((c >= lo) & (c < hi), f"Calibration: among labeled variants scoring {lo * 100:.0f}–{hi * 100:.0f}%, {rate:.0f}% are pathogenic.")
    return out.otherwise("")


def likelihood(p: Column, b: Column) -> Column:
    """p / (p + b), one half for an empty bin or a missing one."""
    total = F.coalesce(p, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))
    return F.when(total > 0, F.coalesce(p, F.lit(0.0)) / total).otherwise(0.5)


def tier(c: Column) -> Column:
    """five tiers by strict bounds."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for low, name in TIERS:
        out = out.when(c > low, name)
    for high, name in LOW_TIERS:
        out = out.when(c < high, name)
    return out.otherwise("uncertain")


def locality(distance: Column) -> Column:
    """at the place, within 5, within 50, or farther."""
    d = F.abs(distance)
    return F.when(d == 0, "at variant").when(d <= 5, "local").when(d <= 50, "regional").otherwise("distal")


def predictor(db: Column, own: Column, invert: bool = False, phred: bool = False) -> Column:
    """the database's value, else the model's; scaled from PHRED and turned round where asked."""
    v = F.coalesce(db, own)
    v = 1 - F.pow(F.lit(10.0), -v / 10) if phred else v
    return 1 - v if invert else v


def contig(c: Column) -> Column:
    """F32: without a leading chr, M as MT."""
    bare = F.regexp_replace(c, "^(?i:chr)", "")
    return F.when(bare == "M", "MT").otherwise(bare)


def id_part(c: Column, n: int, mark: str = ":") -> Column:
    """the n-th part (from 1) of an id, empty beyond the last."""
    return F.split_part(c, F.lit(mark), F.lit(n))


def expectation(logits: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """the mean of the bin centres under the softmax of the logits."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x.cast("double") - top.cast("double")))
    n = F.size(logits)
    weighted = F.aggregate(F.transform(e, lambda x, i: x * (lo + (i + 0.5) * (hi - lo) / n)), F.lit(0.0), lambda a, x: a + x)
    return weighted / F.aggregate(e, F.lit(0.0), lambda a, x: a + x)


def argmax(values: Column) -> Column:
    """the zero-based place of the largest value, the first of equals."""
    return F.array_position(values, F.array_max(values)) - 1


def soft_bins(c: Column, n: int, sigma: float) -> Column:
    """Gaussian weights of n bin centres on the unit range, summing to 1."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.exp(-F.pow((c - (i + 0.5) / n) / sigma, 2) / 2))
    return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, y: a + y))


def fnv1a(texts):
    """64-bit FNV-1a of UTF-8 texts (a pandas Series) in hexadecimal; no built-in function has it."""
    def one(t):
        if t is None:
            return None
        h = 0xCBF29CE484222325
        for byte in t.encode():
            h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    return texts.map(one)


def fnv1a_hex(c: Column) -> Column:
    return F.pandas_udf(fnv1a, "string")(c)


def coding(keys: list[Column], impact: Column, consequence: Column, shown: Column) -> Column:
    """P10: all keys non-blank, and a coding impact or a coding term in the consequence or its display text; never null."""
    filled = F.lit(True)
    for k in keys:
        filled = filled & (F.coalesce(F.trim(k.cast("string")), F.lit("")) != "")
    has = lambda c, terms: F.coalesce(F.lower(c), F.lit("")).rlike("|".join(terms))  # noqa: E731 - plain words, no pattern characters
    return filled & (F.coalesce(impact.isin(*CODING_IMPACTS), F.lit(False)) | has(consequence, CODING_TERMS) | has(shown, CODING_DISPLAY_TERMS))


def clinical_class(c: Column) -> Column:
    """Pathogenic or benign where the text has one word and not the other (any case), else null."""
    bad, good = F.contains(F.lower(c), F.lit("pathogenic")), F.contains(F.lower(c), F.lit("benign"))
    return F.when(bad & ~good, "pathogenic").when(good & ~bad, "benign")


def title_case(c: Column) -> Column:
    """A capital after anything but a letter, small letters after letters."""
    letters = F.split(c, "")
    before = lambda i: F.coalesce(F.get(letters, i - 1), F.lit(" ")).rlike(r"\p{L}")
    return F.array_join(F.transform(letters, lambda x, i: F.when(before(i), F.lower(x)).otherwise(F.upper(x))), "")


def head_display(c: Column, overrides: dict[str, str], prefixes: tuple[str, ...]) -> Column:
    """an override, else without a final ``_c`` and the first known prefix, in title case with acronyms mended.

    A rest of at most two characters keeps the prefix before it in capitals; accessions (``PF...``) stay as they are."""
    base = F.regexp_replace(c, "_c$", "")
    cut = F.coalesce(*(F.when(F.startswith(base, F.lit(p)), F.lit(p)) for p in prefixes), F.lit("")) if prefixes else F.lit("")
    rest = F.substring(base, F.length(cut) + 1, F.length(base))
    short = F.concat_ws(" ", title_case(F.replace(F.regexp_replace(cut, "_+$", ""), F.lit("_"), F.lit(" "))), F.upper(rest))
    spaced = F.replace(rest, F.lit("_"), F.lit(" "))
    shown = title_case(spaced)
    for wrong, right in ACRONYMS:
        shown = F.replace(shown, F.lit(wrong), F.lit(right))
    known = F.create_map(*(F.lit(x) for kv in overrides.items() for x in kv)) if overrides else F.create_map(F.lit(""), F.lit(""))
    return F.coalesce(F.try_element_at(known, c), F.when((cut != "") & (F.length(rest) <= 2), short).when(F.startswith(spaced, F.lit("PF")), spaced).otherwise(shown))


def consequence_bin(shown: Column) -> Column:
    """one of five bins, null for any other consequence."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in CONSEQUENCE_BINS.items() for x in kv)), shown)


def hgvs_consistent(protein: Column, consequence: Column) -> Column:
    """false for an unchanged protein (``=``) under a missense consequence and for a changed one under a synonymous one."""
    p = F.coalesce(protein, F.lit(""))
    equal = F.contains(p, F.lit("="))
    clash = (equal & (consequence == "missense_variant")) | (~equal & (p != "") & (consequence == "synonymous_variant"))
    return ~F.coalesce(clash, F.lit(False))


def population_widths(frequencies: dict[str, Column]) -> dict[str, Column]:
    """each population's frequency as a percentage of the largest (1e-6 at least), 2 at least where it was seen, else 0."""
    most = F.greatest(F.lit(1e-6), *(F.coalesce(c, F.lit(0.0)) for c in frequencies.values()))
    return {k: F.when(c > 0, F.greatest(F.lit(2.0), c / most * 100)).otherwise(0.0) for k, c in frequencies.items()}


def consensus(flags: list[Column]) -> tuple[Column, Column]:
    """how many predictors call it damaging, and how many have a call."""
    return sum((F.coalesce(f.cast("int"), F.lit(0)) for f in flags), F.lit(0)), sum((f.isNotNull().cast("int") for f in flags), F.lit(0))


def row_differences(a: Column, b: Column) -> dict[str, Column]:
    """Mean and median absolute difference, their L2 and cosine of two number arrays over places where neither is null or NaN.

    All are null without such a place; the cosine with fewer than two or where one side is 0."""
    pairs = F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    num = lambda v: v.cast("double")
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + f(num(p["x"]), num(p["y"])))
    n, sizes = F.size(pairs), F.array_sort(F.transform(pairs, lambda p: F.abs(num(p["x"]) - num(p["y"]))))
    middle = (F.get(sizes, F.floor((n - 1) / 2).cast("int")) + F.get(sizes, F.floor(n / 2).cast("int"))) / 2
    norms = F.sqrt(total(lambda x, y: x * x)) * F.sqrt(total(lambda x, y: y * y))
    some = lambda c: F.when(n > 0, c)
    return {"mean_diff": some(total(lambda x, y: F.abs(x - y)) / n), "median_diff": some(middle), "l2": some(F.sqrt(total(lambda x, y: (x - y) * (x - y)))), "cosine": F.when((n > 1) & (norms > 0), total(lambda x, y: x * y) / norms)}


def domain_display(heads: DataFrame, head: str, names: DataFrame, accession: str, name: str, prefixes: tuple[str, ...], overrides: dict[str, str] | None = None) -> DataFrame:
    """heads with ``shown``: ``head_display``, and where that is an accession of names, the name there.

    An accession may carry a version after a point. Of repeated accessions the smallest name counts."""
    shown = heads.withColumn("shown", head_display(F.col(head), overrides or {}, prefixes))
    table = names.filter(F.col(accession).isNotNull()).groupBy(F.col(accession).alias("dd_key")).agg(F.min(name).alias("dd_name"))
    found = shown.join(table, F.substring_index("shown", ".", 1) == F.col("dd_key"), "left")
    return found.withColumn("shown", F.coalesce("dd_name", "shown")).drop("dd_key", "dd_name")
