"""Secret scans: three fixed patterns and a battery of randomness tests.

A long token is compared with what its encoding (hex, base32, base64 and so on) would give if it
were random: a chi-squared test of alphabet uniformity, a runs test of character classes and a
lag-1 serial correlation.  Each gives a p-value under the ordinary hypothesis, letters as European
prose has them; they are combined by Fisher's method.  Digits alone are never called random: all
their frequencies are ordinary.  Discoveries are
controlled per length class by Benjamini-Hochberg over a histogram of all p-values, so short
tokens, which are many and weak, do not set the level of long ones.

Everything is counted over all documents; what the driver sees is the histogram of at most
``CLASSES`` x ``LEVELS`` cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lociq.llm.common import Stages, plain, whole

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A shorter match of these can only be part of a longer one, so the length goes into the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: What the battery looks at.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
MIN_ASSIGNED = 12

#: Length classes 20-31, 32-63, 64-127, ...; the last is open.
CLASSES = 8
#: p-values are binned by powers of 10^-0.25; a bin counts as its upper edge.
LEVELS = 160
FALSE_SHARE = 0.001
#: Share of neighbouring characters of different classes in ordinary tokens.
ORDINARY_SWITCH = 0.12


def spans(text: Column, pattern: str, keep=None) -> Column:
    """``array<struct<start,end>>`` of leftmost non-overlapping matches, in code points.

    The pieces between matches and the matches themselves give the places by running lengths.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern)
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("found"))
    pairs = F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("gap"), matches.alias("match"))

    def step(done, x):
        start = done["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("text")))
        return F.struct(end.alias("at"), F.concat(done["found"], span).alias("found"))

    found = F.when(F.size(matches) > 0, F.aggregate(pairs, first, step)["found"]).otherwise(first["found"])
    return F.filter(found, keep) if keep is not None else found


def _assigned(span: Column) -> Column:
    """The value has enough characters; the dropped part is keyword, marks and blanks."""
    return F.length(F.regexp_extract(span["text"], ASSIGN, 2)) >= MIN_ASSIGNED


def _log_upper_tail(z: Column) -> Column:
    """-ln of the normal upper tail, by the bound z/(1+z^2) pdf from z=2 on and a fit below."""
    far = z * z / 2 + F.log((1 + z * z) / z) + 0.9189385332046727
    near = -F.log(1 / (1 + F.exp(1.5976 * z + 0.070565988 * z * z * z)))
    return F.when(z > 2, far).otherwise(F.greatest(near, F.lit(0.0)))


def alphabet_size(token: Column) -> Column:
    """Letters of the smallest usual encoding that the token fits."""
    return (
        F.when(token.rlike("^[0-9]+$"), 10)
        .when(token.rlike("^[a-z]+$|^[A-Z]+$") & ~token.rlike("^([a-f]+|[A-F]+)$"), 26)
        .when(token.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), 16)
        .when(token.rlike("^[A-Z2-7]+=*$|^[a-z2-7]+=*$"), 32)
        .when(token.rlike("^[0-9a-z]+$|^[0-9A-Z]+$"), 36)
        .when(token.rlike("^[0-9A-Za-z]+$"), 62)
        .otherwise(64)
    ).cast("double")


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _moments(token: Column) -> Column:
    """One walk along a token: sums of its codes, their squares and their neighbours' products."""
    start = {name: F.lit(0.0).alias(name) for name in ("sum", "squares", "lagged", "first", "last")}

    def step(done: Column, letter: Column) -> Column:
        code = F.ascii(letter).cast("double")
        return F.struct(
            (done["sum"] + code).alias("sum"),
            (done["squares"] + code * code).alias("squares"),
            (done["lagged"] + done["last"] * code).alias("lagged"),
            F.when(done["first"] > 0, done["first"]).otherwise(code).alias("first"),
            code.alias("last"),
        )

    return F.aggregate(F.split(token, ""), F.struct(*start.values()), step)


def _letter_squares(token: Column, length: Column) -> Column:
    """Sum of the squared counts of a token's letters; there are at most 66 of them."""
    letters = F.array_distinct(F.split(token, ""))
    return F.aggregate(
        letters, F.lit(0.0), lambda a, c: a + F.pow((length - F.length(F.replace(token, c, F.lit("")))).cast("double"), F.lit(2.0))
    )


def battery(token: Column) -> Column:
    """Combined -ln p of "this is an ordinary token"; 0 where the token fails as a random one.

    Ordinary letters are far from uniform: their chi-squared grows with the length.  With squared
    letter frequencies summing to ``s`` the expected index is ``k s n``, against ``k`` for random
    tokens, so the observed index is held against the ordinary one.  Where the encoding has digits
    or both cases, their runs are tested too; letters of one case have no such runs, and the other
    two tests decide.  Time is in proportion to the token's length.
    """
    core = F.regexp_replace(token, "[^0-9A-Za-z]", "")
    measured = F.struct(
        F.length(token).cast("double").alias("n"),
        alphabet_size(token).alias("k"),
        _letter_squares(token, F.length(token)).alias("letters"),
        F.size(F.array_distinct(F.split(token, ""))).alias("distinct"),
        # Separators join the words of ordinary names; only digits and cases make runs.
        F.greatest(F.length(core) - 1, F.lit(1)).cast("double").alias("places"),
        F.regexp_count(core, F.lit("[0-9]+|[A-Z]+|[a-z]+")).cast("double").alias("runs"),
        token.rlike("^([a-z]+|[A-Z]+)$").alias("one_case"),
        _moments(token).alias("codes"),
    )
    return bound(measured, lambda m: bound(_tests(m), lambda t: _combined(m, t)))


def _tests(m: Column) -> Column:
    """The three statistics of a measured token."""
    n, k, codes = m["n"], m["k"], m["codes"]
    chi = k / n * m["letters"] - n
    df = k - 1
    # Under ordinary text the sum of squared frequencies is about 0.065 whatever the alphabet.
    shift = F.greatest(n * (k * 0.065 - 1), F.lit(0.0))
    mean = codes["sum"] / n
    spread = codes["squares"] - n * mean * mean
    lagged = codes["lagged"] - mean * (2 * codes["sum"] - codes["first"] - codes["last"]) + (n - 1) * mean * mean
    places = m["places"]
    return F.struct(
        # Under uniform letters: chi has mean k - 1 and variance 2 (k - 1).
        (F.abs(chi - df) / F.sqrt(2 * df) < 4).alias("uniform"),
        ((df + shift - chi) / F.sqrt(2 * (df + 2 * shift))).alias("z_chi"),
        ((m["runs"] - 1 - places * ORDINARY_SWITCH) / F.sqrt(places * ORDINARY_SWITCH * (1 - ORDINARY_SWITCH))).alias("z_runs"),
        F.when(spread > 1e-9, lagged / spread * F.sqrt(n)).otherwise(F.lit(99.0)).alias("serial"),
    )


def _combined(m: Column, t: Column) -> Column:
    random_like = t["uniform"] & (F.abs(t["serial"]) < 3.5) & ((m["runs"] >= 3) | m["one_case"]) & (m["distinct"] >= 8)
    # An ordinary token alternates letters of low and high code, which pulls the correlation down.
    two = _log_upper_tail(t["z_chi"]) + _log_upper_tail(1.0 - F.abs(t["serial"]))
    three = two + _log_upper_tail(t["z_runs"])
    # Fisher: -2 (ln p1 + ... + ln pj) is chi-squared with 2j degrees, whose tail is a short sum.
    of_two = bound(two, lambda x: x - F.log(1 + x))
    of_three = bound(three, lambda x: x - F.log(1 + x + x * x / 2))
    return F.when(random_like, F.greatest(F.when(m["one_case"], of_two).otherwise(of_three), F.lit(0.0))).otherwise(0.0)


def length_class(n: Column) -> Column:
    return F.least(F.floor(F.log2(n / 16.0)).cast("int"), F.lit(CLASSES - 1))


def level(minus_ln_p: Column) -> Column:
    return F.least(F.floor(minus_ln_p / (0.25 * 2.302585092994046)).cast("int"), F.lit(LEVELS - 1))


def discovery_levels(candidates: DataFrame, false_share: float = FALSE_SHARE) -> dict[int, int]:
    """Lowest level that counts as a discovery in each length class (Benjamini-Hochberg).

    ``candidates`` has ``class`` and ``level``; classes without a discovery are missing.
    """
    counts = candidates.groupBy("class", "level").count().collect()
    out = {}
    for c in {r["class"] for r in counts}:
        at = {r["level"]: r["count"] for r in counts if r["class"] == c}
        total, above = sum(at.values()), 0
        for b in sorted(at, reverse=True):
            above += at[b]
            if total * 10 ** (-0.25 * b) / above <= false_share:
                out[c] = b
    return out


def _listed(found: Column) -> Column:
    return F.array_join(
        F.transform(
            F.array_sort(found),
            lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def scan(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``, one row per document.

    ``spans`` joins ``kind:start:end`` by start, then kind; the battery's spans have kind
    ``random`` and never overlap those of a pattern.  Null texts are empty and have none.  Rows
    that repeat an id are scanned one by one.
    """
    stages = Stages(docs.sparkSession, "secrets")
    text = F.col("_llm_t")
    rows = plain(docs, "doc_id", "text").select("doc_id", whole("text").alias("_llm_t"))
    found = rows.withColumns(
        {
            "assign": spans(text, ASSIGN, _assigned),
            "access": spans(text, ACCESS),
            "hex": spans(text, HEX),
            "tokens": spans(text, TOKEN),
        }
    ).drop("_llm_t")

    def kind(name: str) -> Column:
        number = F.lit(KINDS.index(name))
        return F.transform(name, lambda s: F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end")))

    based = found.withColumn("base", F.concat(kind("assign"), kind("access"), kind("hex")))
    free = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    tested = F.transform(
        free,
        lambda t: F.struct(
            t["start"].alias("start"), t["end"].alias("end"), length_class(F.length(t["text"])).alias("class"), level(battery(t["text"])).alias("level")
        ),
    )
    scanned = stages.keep(
        based.select(
            "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], "base", tested.alias("tokens")
        ),
        "scanned",
    )
    levels = discovery_levels(scanned.select(F.explode("tokens").alias("t")).select("t.class", "t.level"), false_share)
    least = F.create_map(*[F.lit(x) for c in range(CLASSES) for x in (c, levels.get(c, LEVELS))])
    flagged = F.filter("tokens", lambda t: t["level"] >= F.element_at(least, t["class"]))
    random = F.transform(flagged, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return scanned.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", random)).alias("spans"),
    )
