import random
import re

import pytest

from plumbline.llm.licenses import TEMPLATES, fitted, license_scan


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(3)
    vocabulary = "the of and work in is this by to a under that be public use for with or any code version general terms software permission copy".split() + [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows, want = [], set()
    for i in range(240):
        lines = [say(rng.randint(1, 40)) for _ in range(rng.randint(1, 5))]
        if i % 4 == 0:
            family = rng.choice(list(TEMPLATES))
            at = rng.randrange(len(lines) + 1)
            lines.insert(at, rng.choice(["", say(6) + " "]) + rng.choice(TEMPLATES[family]) + rng.choice(["", " " + say(5)]))
            want.add((i, at, family))
        rows.append((i, "\n".join(lines), "p", 0))
    rows += [(900, None, "p", 0), (901, "", "p", 0), (902, "\n \n.", "p", 0), (903, "license", "p", 0), (None, TEMPLATES["MIT"][0], "p", 0), (904, say(30_000) + "\n" + TEMPLATES["ISC"][0], "p", 0)]
    rows += [rows[0], (905, "\n".join([TEMPLATES["BSD"][0]] * 3), "p", 0)]
    want |= {(None, 0, "MIT"), (904, 1, "ISC"), (905, 0, "BSD"), (905, 1, "BSD"), (905, 2, "BSD")}
    return spark.createDataFrame(rows, "doc_id long, text string, paragraph string, probability int"), want


def test_planted_notices_are_found_and_prose_is_left_alone(frame):
    df, want = frame
    found = license_scan(df).collect()
    got = {(r.doc_id, r.paragraph, r.family) for r in found}
    assert len(found) == len(got)
    assert len(got & want) >= 0.95 * len(want), want - got
    assert len(got - want) <= 0.05 * len(want), got - want
    assert all(0.5 <= r.probability <= 1 and 0.6 <= r.similarity <= 1 for r in found)


def plain_grams(text):
    w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
    return {tuple(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)}


def test_confirmation_agrees_with_plain_sets(frame):
    df, _ = frame
    texts = {(r.doc_id, r.text) for r in df.collect() if r.text}
    for r in license_scan(df).collect():
        near = []
        for doc_id, text in texts:
            lines = text.split("\n")
            if doc_id == r.doc_id and r.paragraph < len(lines):
                run = lines[r.paragraph :]
                run = run[: next((i for i, x in enumerate(run) if not re.search("[A-Za-z0-9]", x)), len(run))]
                for unit in (lines[r.paragraph], "\n".join(run)):
                    shares = [len(plain_grams(unit) & plain_grams(t)) / len(plain_grams(t)) for t in TEMPLATES[r.family]]
                    near.append((max(shares), -shares.index(max(shares))))
        assert any(abs(x - r.similarity) < 1e-9 and -t == r.template for x, t in near)


def test_unknown_class_on_text_it_did_not_see(spark):
    """Prose about licences that names none; the classifier's sample is from other documents."""
    rng = random.Random(11)
    talk = "the license of this software is public and free for any use under general terms with permission to copy modify and distribute the work in source form by the author as published".split()
    seen = [(i, "\n".join(" ".join(rng.choice(talk + [f"v{k}" for k in range(60)]) for _ in range(20)) for _ in range(3))) for i in range(150)]
    new = [(1000 + i, " ".join(rng.choice(talk) for _ in range(25))) for i in range(150)]
    model = fitted(spark.createDataFrame(seen, "doc_id long, text string"))
    found = license_scan(spark.createDataFrame(new, "doc_id long, text string"), model=model).count()
    assert found <= 3


def test_few_documents(spark):
    one = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    assert {(r.doc_id, r.family) for r in license_scan(one).collect()} == {(1, "MIT")}
    assert license_scan(one.limit(0)).count() == 0


def test_wrapped_notices(spark):
    rows, want = [], set()
    for k, family in enumerate(["MIT", "BSD", "ISC", "LGPL", "GPL-3.0"]):
        for j, (width, lead) in enumerate([(40, ""), (72, " * "), (60, "# ")]):
            words, lines = TEMPLATES[family][1].split(), [""]
            for w in words:
                lines = [*lines[:-1], f"{lines[-1]} {w}".strip()] if len(lines[-1]) + len(w) < width else [*lines, w]
            notice = [lead + x for x in lines]
            assert len(notice) > 1
            text = ["kalo mira", "some words of prose", lead.rstrip(), *notice, lead.rstrip(), "and others after it"]
            rows.append((10 * k + j, "\n".join(text)))
            want.add((10 * k + j, 3, family))
    # a line that names the family tells of its run; words on both sides of a blank line are no passage
    rows += [(90, "kalo mira\n" + TEMPLATES["MIT"][0] + "\nsome prose"), (91, "\n\n".join(TEMPLATES["MIT"][1].split())), (92, None), (93, "\n\n")]
    want.add((90, 1, "MIT"))
    found = license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.paragraph, r.family) for r in found) == sorted(want)
    assert all(r.similarity >= 0.9 for r in found)
