import hashlib
import random
import re
import zlib

import pytest

import corpus_pipeline
from quillmark.llm import decontaminate, language, mixing, near_dedup, pii, queries, quality
from tests.llm.test_quality_decontaminate import brute_quality, brute_scan
from tests.llm.test_suffix_near import brute_classes

SYLLABLES = {"en": ["th", "ing", "er", "ou", "ea"], "fr": ["eau", "é", "ou", "ai", "qu"], "de": ["sch", "ei", "ung", "ü", "tz"], "es": ["ción", "ñ", "rr", "os", "ll"], "it": ["zz", "gli", "ia", "che", "ò"]}


def sentence(rnd, lang):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(5, 60)))


@pytest.mark.parametrize("langs", [["en"], ["en", "fr"], ["en", "fr", "de", "es"], ["en", "fr", "de", "es", "it"]])
def test_held_out_accuracy(spark, langs):
    rnd = random.Random(1)
    rows = [(i, sentence(rnd, lang), lang) for i in range(400) for lang in [langs[i % len(langs)]]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    model = language.fit(df.filter("crc32(cast(doc_id as string)) % 3 <> 1"))
    assert model.languages == sorted(langs)
    held = language.predict(df.filter("crc32(cast(doc_id as string)) % 3 = 1"), model, ["lang"]).collect()
    assert len(held) > 80 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_code_words_differ_in_many_bits():
    for n in (2, 3, 4, 5, 12):
        code = language.codewords(n)
        far = min((code[a] != code[b]).sum() for a in range(n) for b in range(a))
        assert far >= (1 if n == 2 else 2 if n == 3 else 4)


def test_language_edges(docs, no_docs, awkward):
    model = language.fit(docs)
    rows = language.predict(docs, model, ["text"]).collect()
    assert len(rows) == len(awkward) and set(model.languages) == {"en", "fr"}
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in ("en", "fr")) == letters and (letters or r.score == 0)
    nothing = language.fit(no_docs)
    assert {r.lang_pred for r in language.predict(docs, nothing, []).collect()} == {"und"}
    assert language.predict(no_docs, model, ["doc_id"]).count() == 0


def test_op8_learns_from_the_stated_rows_alone(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, sentence(rnd, "fr" if i % 2 else "en"), "fr" if i % 2 else "en", "s", 1) for i in range(60)]
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = [(i, t, "zz" if i in held else lang, s, n) for i, t, lang, s, n in rows] + [(None, "the thing", "yy", "s", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in language.op8_language_id(spark, str(tmp_path)).collect()}
    assert {r.lang_pred for r in got.values()} == {"en", "fr"} and sorted(i for i in got if got[i].held_out) == held


def brute_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_spans_equal_brute_force():
    rnd, alphabet = random.Random(2), "a.@-b+%0123456789 ().c\né"
    for _ in range(30_000):
        s = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(s) == brute_pii(s), s


def test_rules_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "+1" * 150_000, "@" * 200_000, "a@" * 100_000, "(" * 200_000, "1:" * 100_000, "=a" * 100_000, '="abcd1' * 50_000, "f" * 300_000, "".join(f"555-{i:07d} x\n" for i in range(100_000))):
        base, words = pii.base_spans(text) + pii.secret_spans(text), [m.span() for m in pii.WORD.finditer(text)]
        for _, s, e in pii.candidates(text, base):
            pii.patterns(text, words, s, e)


def brute_free(text):
    """Candidates by comparing each with all others."""
    base, taken, out = pii.base_spans(text) + pii.secret_spans(text), [], []
    for rule in (pii.ADDRESS, pii.COLONS, pii.NUMBER, pii.ASSIGNED):
        for m in rule.finditer(text):
            s, e = m.span(m.re.groups)
            if rule in (pii.ADDRESS, pii.ASSIGNED):
                e = s + len(text[s:e].rstrip(".,;:!?)>]\"'"))
                s = e - len(text[s:e].lstrip("(<[\"'"))
            digits = len(re.findall("[0-9]", text[s:e]))
            fits = {pii.ADDRESS: "email" if "@" in text[s:e] else "", pii.COLONS: "ip", pii.NUMBER: ",".join(k for k, ok in (("card", 12 <= digits <= 19), ("phone", 7 <= digits <= 15)) if ok), pii.ASSIGNED: pii.SECRET if digits else ""}[rule]
            if s < e and fits and all(e <= a or b <= s for _, a, b in base) and all(e <= a or b <= s for a, b in taken):
                taken.append((s, e))
                out.append((fits, s, e))
    return out


def test_candidates_overlap_nothing():
    rnd, alphabet = random.Random(5), "a1@.:= \"('f-+5"
    for _ in range(20_000):
        s = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
        assert pii.candidates(s, pii.base_spans(s) + pii.secret_spans(s)) == brute_free(s), s


def brute_promoted(texts):
    """The rounds of the graph in plain Python: {text's index: [(kind, start, end)]}."""
    kinds, fits, graph, places = {}, {}, {}, []
    for i, text in enumerate(texts):
        base, words = pii.base_spans(text) + pii.secret_spans(text), [m.span() for m in pii.WORD.finditer(text)]
        for kind, fit, s, e in [(k, k, s, e) for k, s, e in base] + [(None, f, s, e) for f, s, e in pii.candidates(text, base)]:
            value = text[s:e]
            kinds[value], fits[value] = kind or kinds.get(value), fit
            places += [(i, s, e, value)] if kind is None else []
            for p in pii.patterns(text, words, s, e):
                graph.setdefault(p, set()).add(value)
    found = {}
    while True:
        sure = {}
        for p, values in graph.items():
            for k in (*pii.KINDS, pii.SECRET):
                seeds = sum(kinds[v] == k for v in values)
                if seeds >= pii.LEAST_SEEDS and seeds / len(values) >= pii.CONFIDENT:
                    for v in values:
                        if kinds[v] is None and k in fits[v].split(","):
                            sure[v, k] = sure.get((v, k), 1) * max(0.01, 1 - seeds / len(values))
        best = {}
        for (v, k), rest in sure.items():
            if 1 - rest >= pii.PROMOTE:
                best[v] = max(best.get(v, (0, "")), (1 - rest, k))
        if not best:
            return {i: sorted((k, s, e) for n, s, e, v in places if n == i for k in [found.get(v)] if k) for i in range(len(texts))}
        for v, (_, k) in best.items():
            kinds[v] = found[v] = k


def test_promotion_equals_brute_force(spark):
    rnd, texts = random.Random(9), []
    frames = ["call {} now at", "ring {} or {} today", "server {} is down", "login token = '{}' end", "pass: {} ok", "mail {} soon", "code {} x"]
    values = [lambda: f"+1 555 010 {rnd.randint(1000, 1040)}", lambda: f"555-01{rnd.randint(10, 16)}-77", lambda: f"10.0.0.{rnd.randint(1, 30)}", lambda: f"fe80:0:0:{rnd.randint(1, 30)}", lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40)), lambda: f"hunter{rnd.randint(10, 40)}zz", lambda: f"a{rnd.randint(1, 20)}@b.example.org", lambda: f"a{rnd.randint(1, 4)}@bb"]
    prefer = {0: [0, 0, 0, 1], 1: [0, 1], 2: [2, 2, 2, 3], 3: [4, 4, 4, 5], 4: [4, 4, 5], 5: [6, 6, 6, 7], 6: [1, 3, 5]}
    for _ in range(400):
        n = rnd.randrange(len(frames))
        texts.append(f"w{rnd.randint(1, 3)} " + frames[n].replace("{}", "%s") % tuple(values[rnd.choice(prefer[n])]() for _ in range(frames[n].count("{}"))))
    want = brute_promoted(texts)
    got = {r.doc_id: sorted((s.kind, s.start, s.end) for s in r.pii.added) for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3), ["doc_id"]).collect()}
    assert got == want and len({k for x in want.values() for k, _, _ in x}) >= 4


def test_secrets_have_columns_of_their_own(spark, tmp_path):
    hexes = [f"{i:02x}" + "0f1e2d3c4b5a6978" * 3 for i in range(6)]
    rows = [(i, f"the token = '{h}' of mine and 10.0.0.{i}") for i, h in enumerate(hexes)] + [(6, "your token = 'short-1234' of it"), (7, "clean = deadbeef and 1234567")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.op9_personal_data(spark, str(tmp_path)).collect()}
    assert all(got[i].n_secret == 1 and "secret" not in got[i].spans and got[i].n_spans == 2 for i in range(6))
    assert (got[6].secret_spans, got[6].n_added, got[6].spans) == ("secret:14:24", 1, "") and got[7].n_spans == 0
    assert pii.redacted(spark.createDataFrame(rows[:1], "doc_id bigint, text string")).first().text == "the token = '<SECRET>' of mine and <IP>"


PII_ROWS = [(i, f"please call me at +1 555 010 {1000 + i} today thanks, {i} é") for i in range(8)] + [
    (8, "é please call me at 555-0199-77 today thanks"),
    (9, "order number 555-0199-77 shipped"),
    (10, None),
    (11, ""),
    (12, "mail x.y@mail.example.com, 10.0.0.1 and 4111 1111 1111 1111; 999.1.1.1 no"),
    (None, "+1 555 010 1000 1000"),
    (13, "please call me at 555-0100-11 today thanks"),
]


def test_contexts_of_seeds_find_unseen_numbers(spark, no_docs):
    df = spark.createDataFrame([(*r, 1) for r in PII_ROWS], "doc_id bigint, text string, pii int").repartition(2)
    rows = {r.doc_id: r for r in pii.find(df.drop("pii"), ["doc_id", "text"]).collect()}
    for r in rows.values():
        assert [tuple(s) for s in r.pii.spans] == brute_pii(r.text or "")
    added = {k: [r.text[s.start : s.end] for s in r.pii.added] for k, r in rows.items() if r.pii.added}
    assert added == {8: ["555-0199-77"], 9: ["555-0199-77"], 13: ["555-0100-11"]}
    clean = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert clean[8] == "é please call me at <PHONE> today thanks" and clean[10] is None and clean[11] == ""
    assert clean[12] == "mail <EMAIL>, <IP> and <CARD>; 999.1.1.1 no" and clean[9] == "order number <PHONE> shipped"
    assert pii.redacted(df).columns == df.columns
    assert pii.find(no_docs, ["doc_id"]).count() == 0


def test_rounds_go_on_until_none_is_promoted(spark):
    """Seven links of two numbers: what the words before or after a link's numbers tell is confident once the link before is promoted, one round each."""
    word = lambda n: "w" + chr(97 + n // 26) + chr(97 + n % 26)
    unseen, seeds, own = iter(range(100, 999)), iter(range(1000, 9999)), iter(range(20, 600))
    number, seed, other = lambda: f"555-0{next(unseen)}-77", lambda: f"+1 555 010 {next(seeds)}", lambda: word(next(own))
    sides = lambda k: (f"{word(k)} mid", f"nid {word(k + 1)}") if k % 2 else (f"{word(k + 1)} mid", f"nid {word(k)}")
    links = [f"{sides(k)[0]} {number()} {sides(k)[1]}" for k in range(7) for _ in range(2)]
    texts = links + [f"{other()} mid {seed()} nid {other()}" for _ in range(72)] + [f"{other()} mid {number()} nid {other()}" for _ in range(10)]
    for k in range(8):
        for _ in range(4 if k else 6):
            texts.append(f"{word(k)} mid {seed()} {other()} {other()}" if k % 2 else f"{other()} {other()} {seed()} nid {word(k)}")
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), ["doc_id"]).collect()
    assert sorted(r.doc_id for r in found if r.pii.added) == list(range(len(links)))


def test_op9_digest_columns(spark, tmp_path):
    spark.createDataFrame(PII_ROWS, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.op9_personal_data(spark, str(tmp_path)).collect():
        base = brute_pii(next(t for i, t in PII_ROWS if i == r.doc_id) or "")
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in pii.KINDS)


def test_redaction_joins_overlaps(spark):
    df = spark.createDataFrame([(1, "x +1 4111 1111 1111 y 1.2.3.4@a.b z")], "doc_id bigint, text string")
    assert pii.redacted(df).first().text in ("x <PHONE> y <EMAIL> z",)


def test_every_operator_is_registered():
    names = sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES)
    assert names == list(range(1, 11)) and set(queries.ORACLE) <= set(queries.QUERIES)


def test_pipeline_equals_brute_force(spark, awkward, tmp_path):
    rows = [r[:5] for r in awkward if len(r[1] or "") < 10_000] + [(900 + i, f"{awkward[20][1]} ip 10.1.1.{i}", "en", "a", 5) for i in range(2)]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    items = [(1, " ".join(awkward[12][1].split()[2:16])), (2, "no such words")]
    spark.createDataFrame(rows, kind).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    first = [r for r in rows if brute_quality(r[1])[6]]
    df = spark.createDataFrame(first, kind)
    ids, _ = brute_classes(first, near_dedup.inverse_frequencies(near_dedup.document_frequencies(df)))
    kept = {}
    for r, (_, class_id, _) in zip(first, ids):
        if class_id not in kept and r[0] == class_id:
            kept[class_id] = r
    third = [r for r in kept.values() if not brute_scan(r[1], items)[1]]
    assert 0 < len(third) < len(kept) < len(first) < len(rows)
    clean = []
    for r in third:
        text = r[1]
        for k, s, e in reversed(brute_pii(text)):
            text = f"{text[:s]}<{k.upper()}>{text[e:]}"
        clean.append((r[0], text, *r[2:4], len(text)))
    got = corpus_pipeline.run(spark, str(tmp_path))
    want = mixing.takes(spark.createDataFrame(clean, kind))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert quality.filtered(docs).count() == len(first) and decontaminate.MAX_SET_BYTES


CLASHES = "_row _key _made _removed _box _pii _cuts _added _k1 _k2 _own _h _i _s _found _quality _text key text_ size _source _at _from rank block target units _rank quality pii found packed body class node component".split()


def test_clashing_names_of_further_columns(spark):
    from quillmark.llm import line_dedup, suffix_dedup, token_counts
    from quillmark.llm._tables import new_path

    text = "please write to a.b@c.example.org about the quiet orbit of the stone lamp in the river"
    df = spark.createDataFrame([(1, text, "en", "s", "x"), (2, text + " again", "en", "s", "x"), (3, None, None, None, None)], "doc_id bigint, text string, lang string, source string, other string")
    for c in CLASHES:
        df = df.withColumn(c, df.other)
    items = spark.createDataFrame([(1, "about the quiet orbit of the stone lamp in the river")], "item_id bigint, text string")
    names = df.columns
    assert pii.redacted(df).columns == names and pii.redacted(df).filter("text LIKE '%<EMAIL>%'").count() == 2
    assert near_dedup.one_of_each(df).columns == names and near_dedup.near_duplicates(df).count() == 3
    assert quality.filtered(df).columns == names and quality.filtered(df).count() == 2
    for most in (decontaminate.MAX_SET_BYTES, 10):
        found = decontaminate.scan(df, items.unionByName(items.selectExpr("2 as item_id", "'none of it' as text")), [c for c in names if c != "found"], max_bytes=most)
        assert sorted(len(r.found.hit_words) for r in found.collect()) == [0, 11, 11]
    assert decontaminate.without_documents(df, items).columns == names and decontaminate.without_spans(df, items).columns == names
    assert line_dedup.repeats(df, [c for c in names if c != "_removed"]).count() == 3
    assert suffix_dedup.repeats(df, names).count() == 3 and mixing.takes(df).count() == 3
    assert token_counts.counted(df, names, token_counts.vocabulary_path(), new_path(spark, "test-cache")).columns == [*names, "n_tokens"]
    assert language.predict(df, language.fit(df), names).columns == [*names, "lang_pred", "score", "ambiguous"]


def test_pipeline_with_clashing_names_and_without_documents(spark, tmp_path):
    rnd = random.Random(6)
    prose = lambda n: " ".join("".join(rnd.choice(SYLLABLES["en"]) for _ in range(4)) + str(rnd.randint(0, 99)) for _ in range(n))
    rows = [(i, prose(60) + f" a{i}@b.example.org", "en", "s", 9, "x") for i in range(6)] + [(None, prose(60), None, None, None, None), (7, None, None, None, None, None)]
    rows += [rows[0], (9, "x y z " * 20, "en", "s", 9, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, other string")
    for c in CLASHES:
        df = df.withColumn(c, df.other)
    items = spark.createDataFrame([(1, " ".join(rows[1][1].split()[5:17]))], "item_id bigint, text string")
    for name, docs, want in (("some", df, [None, 0, 2, 3, 4, 5]), ("none", df.limit(0), [])):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        made = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert sorted((r.doc_id for r in made), key=lambda x: (x is not None, x)) == want
        now = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, f"{tmp_path}/{name}")
            assert now.columns == df.columns
        assert now.filter("text LIKE '%@%'").count() == 0
    items.limit(0).write.parquet(f"{tmp_path}/bare/benchmark.parquet")
    df.write.parquet(f"{tmp_path}/bare/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/bare").count() == 7
