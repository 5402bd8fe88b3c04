import hashlib
import math
import random
import re
from collections import defaultdict

from plumbline.llm.queries import op12_sanitisation
from plumbline.llm.sanitisation import BASE, KINDS, base_spans, sanitisation, sanitised
from pyspark.sql import functions as F

RULES = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def known(k, m):
    digits = re.sub("[^0-9]", "", m)
    if k == 1:
        return m if all(int(p) <= 255 for p in m.split(".")) else None
    if k == 2:
        return digits if 12 <= len(digits) <= 19 and luhn(digits) else None
    if k == 3:
        return digits if 9 <= len(digits) <= 15 else None
    return m.lower()


def plain_base(text):
    """(start, kind, end, entity), straight from the rule."""
    return sorted((m.start(), k, m.end(), known(k, m[0])) for k, rule in enumerate(RULES) for m in re.finditer(rule, text) if known(k, m[0]) is not None)


TERM = re.compile(r"[^\W_]{3,}")


def class_of(t):
    return "number" if t.isdigit() else "code" if any(c.isdigit() for c in t) else "name" if t[0].isupper() else "word"


def windows(text, spans):
    for a, k, b, e in spans:
        sides = [TERM.findall(re.sub(r"\S*@\S*|\+?[0-9][0-9 ().-]{6,}", " ", x)) for x in (text[max(0, a - 160) : a], text[b : b + 160])]
        beside = sides[0][::-1][:8] + sides[1][:8]
        yield (k, e), tuple(beside)


def plain(texts, support, share):
    """All spans of each text."""
    distinct = sorted(set(texts))
    seen, of_entity, ways, te, ce, t_class = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set), {}
    for text in distinct:
        for entity, window in windows(text, plain_base(text)):
            of_entity[entity].add(text)
            ways[entity].add(window)
            for t in window:
                te[entity, t.lower()].add(text)
                seen[entity, t.lower()].add(window)
                ce[entity, class_of(t)].add(text)
                c = (entity, t.lower())
                t_class[c] = min(t_class.get(c, "z"), class_of(t))
    classes = {c: (lambda t, c=c: any(class_of(m) == c or c == "word" and class_of(m) == "name" for m in re.findall(r"[^\W_]+", t))) for c in ("number", "code", "name", "word")}
    with_class = {c: sum(p(t) for t in distinct) for c, p in classes.items()}
    with_term = defaultdict(int)
    for text in distinct:
        for t in {m.lower() for m in TERM.findall(text)}:
            with_term[t] += 1
    removed = defaultdict(list)
    for (entity, t), both in te.items():
        held = math.log(len(distinct) / len(of_entity[entity]))
        tells = lambda n, alone: math.log(len(distinct) * n / (alone * len(of_entity[entity]))) >= share * held - 1e-9  # noqa: B023, E731
        if len(ways[entity]) >= support and len(seen[entity, t]) >= support and held > 0 and tells(len(both), with_term[t]):
            c = t_class[entity, t]
            removed[t].append(tells(len(ce[entity, c]), with_class[c]))
    out = {}
    for text in distinct:
        base = plain_base(text)
        own = [(a, k, b) for a, k, b, _ in base]
        for m in TERM.finditer(text):
            if m[0].lower() in removed and not any(a < m.end() and m.start() < b for a, _, b, _ in base):
                own.append((m.start(), BASE + any(removed[m[0].lower()]), m.end()))
        out[text] = sorted(own)
    return out


def test_base_spans_agree_with_the_plain_rule(spark):
    rng = random.Random(2)
    parts = ["a", "Zé", "@", ".", "-", " ", "+", "(", ")", "0", "12", "255", "256", "4539578763621486", "49", "x_y%", "\n", "\U0001f600", "b@c.de", "1.2.3.4", "+49 30 1234567", "@@", "..", "00255"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for r in df.select("text", base_spans(F.col("text")).alias("b")).collect():
        assert [(s.start, s.kind, s.end) for s in r.b] == [x[:3] for x in plain_base(r.text)], r.text


def corpus(seed):
    rng = random.Random(seed)
    words = "the of and report field Über river stone month quick plain green".split()
    rows = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 40))) for _ in range(60)]
    people = [("Marlow", "marlow@sea.org", "unit7"), ("Kurtz", "+49 30 7654321", "ivory"), ("Jim", "10.0.0.7", "patna")]
    for name, mark, word in people:
        for _ in range(6):
            line = [rng.choice(words) for _ in range(rng.randint(4, 12))]
            line.insert(rng.randint(0, len(line)), f"{name} {mark}, {word}")
            rows.append(" ".join(line))
        rows.append(f"nothing about {name} but his name. {name.upper()}! {name}@x.yz")
    return rows + rows[:5] + ["", "\U0001f600 " * 30 + rows[-1]]


def test_agrees_with_the_plain_rule(spark):
    for seed, support, share in ((1, 3, 0.9), (2, 2, 0.6), (3, 4, 0.95)):
        texts = corpus(seed)
        expected = plain(texts, support, share)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        got = {r.doc_id: r for r in sanitisation(docs, support, share).collect()}
        for i, text in enumerate(texts):
            assert [(s.start, KINDS.index(s.kind), s.end) for s in got[i].spans] == expected[text], text
        assert sum(k >= BASE for s in expected.values() for _, k, _ in s) > 10


def test_sanitised_texts(spark):
    texts = corpus(1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = sanitisation(docs)
    got = {r.doc_id: r.t for r in docs.join(spans, "doc_id").select("doc_id", sanitised(F.col("text"), F.col("spans")).alias("t")).collect()}
    marlow = [got[i] for i, t in enumerate(texts) if "Marlow" in t]
    assert marlow and all("arlow" not in t.replace("MARLOW", "x") and "sea.org" not in t for t in marlow)
    told = {r.doc_id: r.spans for r in spans.collect()}
    for i, text in enumerate(texts):
        out, at = [], 0
        for s in told[i]:
            if s.start >= at:
                out += [text[at : s.start], "" if s.kind == "remove" else f"[{s['class']}]" if s.kind == "generalise" else f"[{s.kind}]"]
            at = max(at, s.end)
        assert got[i] == "".join(out) + text[at:]


def test_edge_rows_and_columns(spark):
    long = "x" * 200_000 + " 1.2.3.4 " + "9" * 100_000 + " a@b.cd " + "q@" * 20_000 + "1.2.3.4," * 5000
    rows = [(None, None, 1, "u", {"a": 1}), (1, "", 2, "v", None), (1, "call +49 30 1234567", 3, "w", {"b": 2}), (1, "call +49 30 1234567", 3, "w", {"b": 2}), (2, long, 4, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_Email int, own string, near map<string,int>")
    got = sanitisation(docs).collect()
    assert len(got) == 5 and {"own", "near", "n_email"} <= set(got[0].asDict()) and "n_Email" not in got[0].asDict()
    of = {r.own: r for r in got}
    assert of["w"].n_phone == 1 and of["w"].near == {"b": 2} and of["u"].base_sha256 == hashlib.sha256(b"").hexdigest()  and (of["z"].n_ip, of["z"].n_email, of["z"].n_card) == (5001, 2, 0)
    assert [(s.start, s.end) for s in of["z"].spans if s.kind == "ip"][-1] == (len(long) - 8, len(long) - 1)
    assert sanitisation(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, tmp_path):
    texts = [*corpus(1), None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = plain([t or "" for t in texts], 3, 0.9)
    for r in op12_sanitisation(spark, str(tmp_path)).collect():
        base = plain_base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[1] == k for x in base) for k in range(4))
        assert r.spans == ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in expected[texts[r.doc_id] or ""])
