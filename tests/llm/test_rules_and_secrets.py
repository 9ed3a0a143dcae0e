"""URL rules on token classes, and the randomness battery on tokens of any length."""

import math
import random
import string
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociq.llm import main_text, secret_scan, url_rules


def test_classes_of_many_tokens_give_one_rule(spark):
    """Three classes of 60 tokens, bad only where all three meet."""
    classes = [[f"p:{name}{i}" for i in range(60)] for name in "abc"]
    rows = [([t for bit in range(3) if mask >> bit & 1 for t in classes[bit]] + [f"h:{k}"], mask == 7) for mask in range(8) for k in range(40)]
    labelled = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    rules = url_rules.mine_rules(labelled, 0.01, 0.6).collect()
    assert [sorted(map(sorted, r.choices)) for r in rules] == [sorted(map(sorted, classes))]
    # Any member of each class is enough, two classes are not.
    urls = [(1, "http://x.org/a7/b9/c41"), (2, "http://x.org/a7/b9/a8"), (3, "http://x.org/c1/b2/a3/other")]
    base = [(100 + i, "http://y.org/" + "/".join(t.removeprefix("p:") for t in tokens if t.startswith("p:"))) for i, (tokens, _) in enumerate(rows)]
    pages = spark.createDataFrame([(i, u.replace("0", "o")) for i, u in [*urls, *base]], "page_id long, url string")
    labels = spark.createDataFrame([(100 + i, 0 if bad else 1, 0) for i, (_, bad) in enumerate(rows)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, labels).collect()}
    assert all((got[100 + i] == "block") == bad for i, (_, bad) in enumerate(rows))


def plain_battery(token):
    """The battery in plain Python."""
    n = len(token)
    def fits(pattern):
        return all(c in pattern for c in token)

    low, up, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    one_case = fits(low) or fits(up)
    k = 62 if fits(low + up + digits) else 64
    if fits(digits + low) or fits(digits + up):
        k = 36
    if fits(low + "234567") or fits(up + "234567"):
        k = 32
    if one_case:
        k = 26
    if fits(digits + "abcdef") or fits(digits + "ABCDEF"):
        k = 16
    if fits(digits):
        k = 10
    chi = k / n * sum(token.count(c) ** 2 for c in set(token)) - n
    df, shift = k - 1, max(n * (k * 0.065 - 1), 0)
    core = [c for c in token if c.isalnum()]
    kinds = ["d" if c in digits else "u" if c in up else "l" for c in core]
    runs = sum(i == 0 or kinds[i] != kinds[i - 1] for i in range(len(kinds)))
    places = max(len(core) - 1, 1)
    off = np.array([ord(c) for c in token], float)
    off -= off.mean()
    serial = (off[:-1] * off[1:]).sum() / (off**2).sum() * math.sqrt(n) if off.any() else 99.0
    if not (abs(chi - df) / math.sqrt(2 * df) < 4 and abs(serial) < 3.5 and (runs >= 3 or one_case) and len(set(token)) >= 8):
        return 0.0

    def tail(z):
        return z * z / 2 + math.log((1 + z * z) / z) + 0.9189385332046727 if z > 2 else max(math.log(1 + math.exp(1.5976 * z + 0.070565988 * z**3)), 0)

    x = tail((df + shift - chi) / math.sqrt(2 * (df + 2 * shift))) + tail(1 - abs(serial))
    if one_case:
        return max(x - math.log(1 + x), 0)
    x += tail((runs - 1 - places * 0.12) / math.sqrt(places * 0.12 * 0.88))
    return max(x - math.log(1 + x + x * x / 2), 0)


def test_battery_equals_a_plain_one(spark):
    choose = random.Random(4)
    alphabets = [string.digits, string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters + string.digits, "abcdef0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", string.ascii_letters + "+/_-="]
    tokens = ["".join(choose.choices(a, k=n)) for a in alphabets for n in (20, 33, 64, 200) for _ in range(6)]
    tokens += ["a" * 40, "abc_def_ghi_jkl_mno_pqr", "the-quick-brown-fox-jumps-over", "x" * 20 + "Y" * 20, "=" * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", secret_scan.battery(F.col("t")).alias("p")).collect()}
    for i, token in enumerate(tokens):
        assert got[i] == pytest.approx(plain_battery(token), rel=1e-6, abs=1e-6), token


def test_random_letters_of_one_case_are_found(spark):
    choose = random.Random(8)
    words = "several_ordinary_names_of_things and more words here "
    keys = ["".join(choose.choices(a, k=256)) for a in (string.ascii_lowercase, string.ascii_uppercase) for _ in range(3)]
    docs = spark.createDataFrame([(i, f"{words * 5} {key} {words}") for i, key in enumerate(keys)] + [(99, words * 20)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.scan(docs).collect()}
    assert all(got[i].count("random:") == 1 for i in range(6)) and "random:" not in got[99]


def test_long_tokens_take_linear_time(spark):
    """An embedded block of 100,000 characters, and a hundred of 1,000."""
    choose = random.Random(2)
    letters = string.ascii_letters + string.digits
    docs = spark.createDataFrame(
        [(1, "".join(choose.choices(letters, k=100_000)))] + [(k, "".join(choose.choices(letters, k=1000))) for k in range(2, 102)], "doc_id long, text string"
    )
    begin = time.time()
    got = {r.doc_id: r.spans for r in secret_scan.scan(docs).collect()}
    assert time.time() - begin < 60
    assert "random:0:100000" in got[1]


def paragraphs(n, words=60, name="word"):
    return [" ".join(f"{name}{i}x{k}" for k in range(words)) + "." for i in range(n)]


def in_tags(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


@pytest.mark.parametrize("place", ["before", "after"])
def test_a_marked_teaser_does_not_take_the_body(place):
    body = paragraphs(10)
    teaser = "<article><h3>Read this</h3></article>"
    page = f"<html><body><nav>Home</nav>{teaser if place == 'before' else ''}<div>{in_tags(body)}</div>{teaser if place == 'after' else ''}<footer>c</footer></body></html>"
    weights = {"other": -0.5, "p": -0.01, "/p": -0.01}
    text = main_text.main_text(page, weights)
    assert " ".join(body) in text and len(text) <= len(" ".join(body)) + 12


def test_all_marked_regions_are_the_text():
    first, second = paragraphs(1, 30, "first"), paragraphs(5, 60, "second")
    between = " ".join(f"between{k}" for k in range(40))
    page = f"<body><article>{in_tags(first)}</article><div>{between}</div><article>{in_tags(second)}</article></body>"
    assert main_text.main_text(page, {"other": -0.5}) == " ".join([*first, *second])
    # Where the mark holds little of the page, what lies between belongs to the region.
    page = f"<body><div>{in_tags(second)}</div><article>{in_tags(first)}</article><div>{in_tags(second)}</div></body>"
    assert main_text.main_text(page, {"other": -0.5}) == " ".join([*second, *first, *second])
