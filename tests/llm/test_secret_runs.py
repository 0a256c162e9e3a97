"""op2_secret_scan: what is random and what is a name, by form, and against code of the test's own."""

import random
import string

import pytest

from recordloom.llm import secrets

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RANDOM = "q7Zk2VxP9sLm4TbR8wYc1NdF6hJg3QeU"
LETTERS = "qZkVxPsLmTbRwYcNdFhJgQeU"


@pytest.mark.parametrize("text", ["AUTH=" + RANDOM, "https://h/x?sig=" + RANDOM, "AWS_KEY=" + RANDOM + "==", "key " + LETTERS, "key=" + LETTERS, "qzkvxpslmtbrwycndfhjgqeu"])
def test_found(text):
    ((a, _, b),) = secrets.random_spans(text, [], secrets.encoder(VOCABULARY), secrets.MAX_RATIO)
    assert text[a:b] in (RANDOM, RANDOM + "==", LETTERS, text)


@pytest.mark.parametrize("text", ["internationalization_of_everything", "getUserAccountInformationFromServer", "donaudampfschifffahrtsgesellschaft", "is_it_ok_to_go_by_an_id_or_not", "INTERNATIONALIZATION", "-" * 32, "x=" + "AB12" * 10])
def test_words_and_names_are_not(text):
    assert secrets.random_spans(text, [], secrets.encoder(VOCABULARY), secrets.MAX_RATIO) == []


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"])
@pytest.mark.parametrize("more", ["", "0123456789", "0123456789+/"])
@pytest.mark.parametrize("length", [20, 32, 40, 64])
def test_random_strings_of_every_alphabet_are_found(letters, more, length):
    rng = random.Random(length)
    alphabet = letters + more + (letters.swapcase() if more.endswith("/") else "")
    texts = ["key " + "".join(rng.choices(alphabet, k=length)) + " end" for _ in range(200)]
    found = [secrets.random_spans(t, [], secrets.encoder(VOCABULARY), secrets.MAX_RATIO) for t in texts]
    assert sum(bool(f) for f in found) >= 0.97 * len(texts)


def test_few_names_of_invented_words_are_taken_for_random(spark, sf_dir):
    """Words that no language has, joined as names are: the hardest to tell; 19 of 300 when this was written."""
    words = [w for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect() for w in r["text"].split() if w.isalpha()]
    rng = random.Random(1)
    names = ["_".join(rng.sample(words, 4)).lower() for _ in range(300)]
    found = sum(bool(secrets.random_spans(n, [], secrets.encoder(VOCABULARY), secrets.MAX_RATIO)) for n in names)
    assert found <= 0.1 * len(names)


UP, LOW, DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
ALL = UP + LOW + DIGITS
FORMS = {  # (alphabet, length) of each part, and what stands between parts
    "groups of capitals and a number": ([(UP, 8)] * 3 + [(DIGITS, 4)], "-"), "groups of letters and a number": ([(LOW, 10)] * 2 + [(DIGITS, 4)], "_"), "licence of letters": ([(UP, 4)] * 5, "-"),
    "licence": ([(UP + DIGITS, 5)] * 5, "-"), "short licence": ([(UP + DIGITS, 4)] * 5, "-"), "key after a prefix": ([("s", 1), ("k", 1), (ALL, 24)], "_"), "url-safe": ([(ALL + "-_", 43)], ""),
    "16 of base62": ([(ALL, 16)], ""), "16 of base36": ([(LOW + DIGITS, 16)], ""), "18 of letters": ([(LOW, 18)], ""), "16 of capitals": ([(UP, 16)], ""),
}


@pytest.mark.parametrize("form", FORMS)
def test_random_strings_of_every_form_are_found(form):
    rng, (parts, between) = random.Random(form), FORMS[form]
    texts = ["see " + between.join("".join(rng.choices(a, k=n)) for a, n in parts) + " now" for _ in range(300)]
    found = [secrets.random_spans(t, [], secrets.encoder(VOCABULARY), secrets.MAX_RATIO) for t in texts]
    assert sum(bool(f) for f in found) >= 0.95 * len(texts)


@pytest.mark.parametrize("text", [
    "docs/reference/configuration/index", "my_module_v2_final_2023", "2023-11-05-weekly-status-report", "src/main/java/org/apache/spark/sql", "user_profile_picture_large_1024", "SOME_CONSTANT_VALUE_MAX_SIZE",
    "utf8_general_ci_collation", "x86_64-unknown-linux-gnu", "sha256-checksum-file-name", "python3-dev-tools-install", "20231105123456789012", "2023-11-05-12-30-45", "version-2-0-1-release-candidate", "4f9d2c6e-7b1a-4c3d-9e8f-0a1b2c3d4e5f",
])
def test_names_with_digits_are_not(text):
    assert secrets.random_spans(text, [], secrets.encoder(VOCABULARY), secrets.MAX_RATIO) == []


def plainly(text, base, enc, ratio):
    """Random spans by walking characters: maximal runs of key characters, less those that are digests, numbers or names."""
    chars, out, i = set(ALL + "+/_-"), [], 0
    while i < len(text):
        if text[i] not in chars:
            i += 1
            continue
        j = i
        while j < len(text) and text[j] in chars:
            j += 1
        end = j
        while end < len(text) and text[end] == "=" and end < j + 2:
            end += 1
        start, run, bare = i, text[i:end], text[i:j]
        i = j
        if len(bare) < 16 or end < len(text) and (text[end] == "=" or text[end] in chars) or any(s < end and start < e for s, _, e in base):
            continue
        hexed = all(c in string.hexdigits for c in bare)
        groups = bare.split("-")
        uuid = [len(g) for g in groups] == [8, 4, 4, 4, 12] and all(c in string.hexdigits for g in groups for c in g)
        tail = bare
        for mark in ("md5", "sha1", "sha256", "sha384", "sha512"):
            if bare.lower().startswith(mark) and all(c in string.hexdigits for c in bare[len(mark) :].lstrip("-_")):
                tail = bare[len(mark) :].lstrip("-_")
                hexed = True
        if uuid or hexed and len(tail) in (32, 40, 56, 64, 96, 128) or not any(c.isalpha() for c in bare):
            continue
        letters, worded, tokens = 0, 0, 0
        for c in "-_/+":
            bare = bare.replace(c, " ")
        for p in bare.split():
            stem = p.rstrip(DIGITS)
            if not stem:
                continue
            letters += len(p)
            one = stem.isalpha() and (stem.islower() or stem.isupper() or stem[0].isupper() and stem[1:].islower()) and len(p) - len(stem) <= 4
            n = len(enc.encode_ordinary(stem))
            if one and (len(stem) > 4 or n == 1):
                worded, tokens = worded + len(p), tokens + n
        if len(run) < ratio * len(enc.encode_ordinary(run)) and not (2 * worded >= letters and worded >= ratio * tokens):
            out.append((start, 3, end))
    return out


def test_random_spans_against_plain_code(spark, sf_dir):
    enc, rng = secrets.encoder(VOCABULARY), random.Random(7)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for _ in range(4000):
        parts = [rng.choice(["".join(rng.choices(rng.choice([LOW, UP, ALL, DIGITS, "abcdef" + DIGITS, ALL + "+/"]), k=rng.choice([1, 2, 4, 5, 8, 16, 20, 32, 40]))), "value", "Index", "SIZE", "v2", "sha256", "é", "=", " "]) for _ in range(rng.randint(1, 7))]
        texts.append(rng.choice(["", "x ", "a="]) + rng.choice(["", "-", "_", "/"]).join(parts) + rng.choice(["", "=", "==", "===", " end"]))
    for t in texts:
        base = secrets.base_spans(t)
        assert secrets.random_spans(t, base, enc, secrets.MAX_RATIO) == plainly(t, base, enc, secrets.MAX_RATIO), t
