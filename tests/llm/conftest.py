import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with exact and near copies, shared passages, runs, short and long ones, and none."""
    rng = random.Random(3)
    base = [prose(rng, rng.choice([1, 2, 5, 40, 120, 300])) for _ in range(30)]
    passage = prose(rng, 60)
    out = [*base, base[5], base[5], base[3].upper()]
    for k in range(8):
        words = base[6].split()
        words[rng.randrange(len(words))] = f"edit{k}"
        out.append(" ".join(words))
    out += [prose(rng, 30) + " " + passage + " " + prose(rng, 20), passage, prose(rng, 9) + "\n" + passage + "!", "x" * 700, "xy" * 300, "é" * 150 + " " + "é" * 150, "", " \t\n ", "!!! ...", None, prose(rng, 4000), "It's <|endoftext|> \x01 Straße ǅ 12½", "\u0958 \u0958\u0932\u092e J\u030c"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Ids 1, 2, ...; a null id; a repeated row; and columns with names that results have."""
    langs = ["en", "fr", None]
    rows = [(k + 1, t, langs[k % 3], "s", len(t or "")) for k, t in enumerate(texts)]
    rows += [(None, texts[5], None, None, None), rows[7]]
    clash = "row long, id long, kept boolean, score double, component_id long, z binary, start long, found string, held_out boolean, salt long, grp long, pick string, _row string, _z string, _cut string, _text string, _null string, share string, top string, at string, label string, block string, digest string, host string, path string, url string, ids string, votes string, n_words string, good string, term string, phrase string, items string, positions string".split(", ")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3, "n_chars")
    return df.selectExpr("*", *[f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in clash])


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]
