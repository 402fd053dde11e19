"""Classifiers, near duplicates, tokens, packing and surrogates against brute force and on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from timberflow.llm import bpe_automaton, packing, quality, simhash, surrogates, toxicity
from timberflow.llm.queries import QUERIES

TINY = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\t", "word", "A b c d", "a B c D", "x" * 20_000, "tree " * 5_000, "é́ ｆｕｌｌ 👩‍👩‍👧 \x00 <|x|> tail  "]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "clash", k) for k, t in enumerate(ODD)] + [(None, None, None, None), (3, "\n\t", "clash", 3), (3, "\n\t", "clash", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, label long")


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 30)) for _ in range(n)]


def test_classifiers_hold_out(spark):
    for name, label, at in (("op1_toxicity", "toxic", 0.5), ("op2_quality", "quality", 0.7)):
        folder = "/root/testdata/sf0.01"
        rows = QUERIES[name](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
        assert rows.score.between(0, 1).all() and ((rows.score >= at) == (rows.predicted == 1)).all()
        parts, part = (5, 0) if label == "toxic" else (4, 2)
        assert (rows.held_out == [zlib.crc32(str(d).encode()) % parts == part for d in rows.doc_id]).all()
        held = rows[rows.held_out]
        assert ((held.score >= 0.5) == (held[label] == 1)).mean() > 0.85


def test_classifiers_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(8)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for operator, parts, part in ((toxicity, 5, 0), (quality, 4, 2)):
        for known in (labels, labels.limit(0)):
            model = operator.fit(odd, known, parts=parts, part=part)
            scores = [r[0] for r in odd.select(operator.scorer(model)(F.col("text"))).collect()]
            assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)


def test_words_joined_by_marks_are_walked():
    """The test that spares texts the walk lets every text pass that the grammar scores, whatever stands around the word."""
    heads = {w[:4] for w in ("idiot", "kill")}
    for mark in ",.;:!?()[]{}—–…/|<>«»\"'’_*#@=+&%~`^\\$€§°·\u00a0\u200b":
        for text in (f"hello{mark}idiot", f"idiot{mark}", f"{mark}idiot{mark}x", f"you{mark}idiot hello"):
            tokens = toxicity.TOKEN.findall(text.lower().replace("’", "'"))
            if any(t[:4] in heads for t in tokens):
                assert not heads.isdisjoint(w[:4] for w in toxicity.WORDS.findall(text.lower())), text


def test_token_ids_equal_the_library():
    """Words that end in characters which the normalizer takes apart, before marks of every kind."""
    rng = random.Random(6)
    ends = ["İ", "i̇", "é", "e\u0301", "ß", "ǰ", "a", "9", "٣", "ก", "中", "ﬁ", "Å", "ı", "\u200d", "ŉ"]
    marks = [".", ",", "...", ")", '."', "!?", "'s", "-", "|", "<|", "%", ""]
    texts = ["DAKİ.", "KİTABİ, ve", "Nİ)", "", " ", "a<|endoftext|>b", "A <|ENDOFTEXT|> b", "<|startoftext|><|endoftext|> İ", "<|endoftext|"]
    texts += [" ".join("".join(rng.choice("abİIKTéx1") for _ in range(rng.randint(0, 4))) + rng.choice(ends) + rng.choice(marks) for _ in range(rng.randint(1, 8))) for _ in range(4000)]
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    compiled = bpe_automaton.TokenizationAutomaton(PATH)
    got = [np.frombuffer(compiled.encode(t), "<u4").tolist() for t in texts]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_matched_clauses_respect_negation_and_report(spark):
    rows = []
    for k in range(200):
        rows.append((k, "You are an idiot and I will kill you." if k % 2 else "The garden has a tall tree and a pond.", k % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs)
    texts = ["You are an idiot.", "You are not an idiot.", "The garden has a tall tree."]
    direct, negated, clean = [
        r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").select(toxicity.scorer(model)(F.col("text"))).collect()
    ]
    assert direct > negated > clean - 1e-12 and direct > 0.5 > clean


def test_discriminant_separates_shifted_classes():
    rng = np.random.default_rng(5)
    labels = np.arange(600) % 2
    model = quality.fit_matrix(rng.normal(size=(600, len(quality.STATISTICS))) + 1.5 * labels[:, None], labels)
    fresh = rng.normal(size=(400, len(quality.STATISTICS))) + 1.5 * (np.arange(400) % 2)[:, None]
    assert ((model.score(fresh) >= 0.5) == (np.arange(400) % 2 == 1)).mean() > 0.95


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    tokens = [t for t in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if t]
    size = min(3, len(tokens))
    hashes = [xxhash.xxh64_intdigest(" ".join(tokens[k : k + size]).encode(), 42) for k in range(len(tokens) - size + 1)] if tokens else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(prints):
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {f: find(f) for f in prints}


@pytest.mark.parametrize("crowd", [2, 256])
def test_simhash_links_equal_brute_force(spark, crowd):
    rng = random.Random(7)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in values[:30]:
        for _ in range(4):
            values.append(v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values += [values[0] ^ (1 << b) for b in range(64)]
    values = sorted(set(values))
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    got = {(frozenset((r[0] % (1 << 64), r[1] % (1 << 64)))) for r in simhash.links(frame, 2, crowd).select("a", "b").collect()}
    root = brute_groups(values)
    linked = brute_groups_of(got, values)
    assert all(linked[a] == linked[b] for a in values for b in values if root[a] == root[b])
    assert all((min(p) ^ max(p)).bit_count() <= 2 for p in got)


def brute_groups_of(pairs, values):
    group = {v: v for v in values}
    for _ in values:
        before = dict(group)
        for p in pairs:
            low = min(group[v] for v in p)
            for v in p:
                group[v] = low
        if group == before:
            break
    return group


def test_simhash_query_and_odd_rows(spark, odd):
    base = words(random.Random(1), 400)
    near = [*base[:200], "changed", *base[201:]]
    extra = spark.createDataFrame([(100, " ".join(base)), (101, " ".join(base).upper()), (102, " ".join(near))], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(extra)
    rows = docs.collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    root = brute_groups(set(prints))
    expected = sorted(
        (str(r.doc_id), f"{f:016x}", min((q.doc_id for q, g in zip(rows, prints) if root[g] == root[f] and q.doc_id is not None), default=None)) for r, f in zip(rows, prints)
    )
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_text(F.col("fp")), "component_id").collect()
    assert sorted((str(a), b, c) for a, b, c in got) == expected
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_automaton_equals_library(spark, odd):
    rng = random.Random(3)
    plain = [chr(rng.choice([32, 33, 39, 65, 97, 48, 233, 0x4E2D, 0x1F600, 0x0915, 10, 9]) + rng.randint(0, 20)) for _ in range(4000)]
    texts = ODD + ["".join(plain[k : k + 40]) for k in range(0, 4000, 40)] + ["can't stop 12345  numbers\n\n  and   spaces"]
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in frame.select("text", bpe_automaton.codec(PATH)(F.col("text")).alias("c")).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.c.ids, "<u4").tolist() == ids
        assert r.c.decoded == library.decode(ids, skip_special_tokens=False)


def test_table_of_states_may_start_anew(monkeypatch):
    """Memories of a few entries give the ids that unbounded ones give, and a very long word is read like any other."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefghienstrñöß'0., ") for _ in range(60)) for _ in range(300)] + ["ab" * 30_000]
    free = bpe_automaton.TokenizationAutomaton(PATH)
    want = [free.encode(t) for t in texts]
    for name, size in (("MEMORY", 8), ("ARCS", 5), ("STATES", 3)):
        monkeypatch.setattr(bpe_automaton, name, size)
    tight = bpe_automaton.TokenizationAutomaton(PATH)
    assert [tight.encode(t) for t in texts] == want
    assert len(tight.states) <= 4 and len(tight.pieces) <= 5 and len(tight.arcs) <= 6


def test_new_words_are_read_side_by_side(monkeypatch):
    """A chunk's short words take their transitions together, and no text gets ids of another, wherever chunks end."""
    rng = random.Random(12)
    letters = "abcdefghijklmnoprstuvwxyzABÀéß中İ"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) + rng.choice(["", "", ".", "'s", "1)"]) for _ in range(40)) for _ in range(300)]
    texts[5:5] = [None, "", " \n", "a<|endoftext|> b <|ENDOFTEXT|>", "x\x1cy z", "z" * 65 + " " + "z" * 64, "\u2003Ab\x85cd ", "<|startoftext|>"]
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    alone = bpe_automaton.TokenizationAutomaton.encode_word
    single = []
    monkeypatch.setattr(bpe_automaton.TokenizationAutomaton, "encode_word", lambda self, word: single.append(word) or alone(self, word))
    for size in (bpe_automaton.CHUNK, 700, 1):
        monkeypatch.setattr(bpe_automaton, "CHUNK", size)
        compiled = bpe_automaton.TokenizationAutomaton(PATH)
        assert [np.frombuffer(b, "<u4").tolist() for b in compiled.encode_all(texts)] == want
        assert list(compiled.encode_all([])) == []
    assert {len(word) for word in single} == {65}


def test_tokens_query_covers_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    for r in QUERIES["op5_bpe_encode_decode"](spark, TINY).collect():
        ids = library.encode(docs.pop(r.doc_id) or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert not docs


def check_packing(rows, capacity):
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def test_packing_is_whole_and_tight(spark, odd):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    rows = packing.pack_documents(odd, PATH).collect()
    expected = []
    for r in odd.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            expected.append((str(r.doc_id), k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    check_packing(rows, 4096)
    assert packing.pack_documents(odd.limit(0), PATH).count() == 0


@pytest.mark.parametrize("draw", [lambda g: g.randint(1, 100), lambda g: g.randint(30, 60), lambda g: 100])
def test_packing_plan_near_lower_bound(spark, draw):
    rng = random.Random(11)
    rows = [(k, 0, 0, draw(rng)) for k in range(2000)]
    found = packing.materialize(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long"))
    used = check_packing(packing.pack(found, 100).collect(), 100)
    lower = max(-(-sum(r[3] for r in rows) // 100), sum(r[3] > 50 for r in rows))
    assert used <= lower * 1.2 + 1


TEXTS = [
    "Mail ann.lee@example.org or ANN.LEE@EXAMPLE.ORG, host 10.20.30.40.",
    "Call +1 (555) 010-7788 or 555-010-7788.",
    "Card 4111 1111 1111 1111 and IBAN DE44 5001 0517 5407 3249 31.",
    "Dear Mr. John Smith, Mrs. Mary Smith says hello. Mr. Smith left.",
    "plain text without anything, version 2.0",
    "",
    None,
]


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits)) % 10 == 0


def test_surrogates_keep_format_and_coreference(spark):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS + TEXTS)], "doc_id long, text string, names string")
    rows = {r.doc_id: r for r in surrogates.replace(docs, "key").collect()}
    assert len(rows) == len(TEXTS) * 2 and all(r.names == "clash" for r in rows.values())
    n = len(TEXTS)
    assert all(rows[k].text == rows[k + n].text for k in range(n))
    for k in (4, 5, 6):
        assert rows[k].text == TEXTS[k]
    mail, phone, card, name = (rows[k].text for k in range(4))
    first, second = mail.split()[1], mail.split()[3].rstrip(",")
    assert first.lower() == second.lower() and second.isupper() and "ann.lee" not in mail.lower() and "10.20.30.40" not in mail
    assert [c.isdigit() for c in phone] == [c.isdigit() for c in TEXTS[1]] and "010-7788" not in phone
    number = card[5:24]
    assert luhn(number) and number != "4111 1111 1111 1111" and card.count(" ") == TEXTS[2].count(" ")
    assert "Smith" not in name and "John" not in name and name.count(name.split("Mr. ")[1].split(",")[0].split()[-1]) == 3
    other = {r.doc_id: r.text for r in surrogates.replace(docs, "other key").collect()}
    assert other[0] != mail
    assert surrogates.replace(docs.limit(0), "key").count() == 0


def test_surrogates_keep_distinctness(spark):
    rng = random.Random(2)
    mails = sorted({f"user{rng.randint(0, 9999)}@site{rng.randint(0, 99)}.org" for _ in range(500)})
    docs = spark.createDataFrame([(k, m) for k, m in enumerate(mails)], "doc_id long, text string")
    new = [r.text for r in surrogates.replace(docs, "key").collect()]
    assert len(set(new)) == len(mails)
    names = [f"Mr. {a}{b} Stone" for a in "BCDFGHKLM" for b in ("ill", "ob", "an", "im", "on")]
    new = [r.text for r in surrogates.replace(spark.createDataFrame(list(enumerate(names)), "doc_id long, text string"), "key").collect()]
    assert len(set(new)) == len(names)


def test_surrogates_of_long_entities_and_names(spark):
    rng = random.Random(4)
    long_hex = "".join(rng.choice("0123456789abcdef") for _ in range(132))
    long_key = "".join(rng.choice("abcdefXYZ0123456789+/") for _ in range(200_000))
    texts = [
        f"sum {long_hex} end",
        f"api_key={long_key}",
        "Mr. Juan Carlos García Márquez Gabriel came.",
        "Ring +49 151 23456789 or +4915123456789.",
        "ring ÜBERßEN.İNCE@exämple.org now",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = [r.text for r in surrogates.replace(docs, "key").orderBy("doc_id").collect()]
    number = new[0].split()[1]
    assert len(number) == 132 and number != long_hex and set(number) <= set("0123456789abcdef")
    secret = new[1].removeprefix("api_key=")
    assert len(secret) == len(long_key) and sum(a == b for a, b in zip(secret, long_key)) < 0.3 * len(long_key)
    assert all(a.isdigit() == b.isdigit() and a.isupper() == b.isupper() for a, b in zip(secret, long_key))
    assert not {"Juan", "Carlos", "García", "Márquez", "Gabriel"} & set(new[2].split()) and len(new[2].split()) == 7
    first, second = new[3].removeprefix("Ring ").rstrip(".").split(" or ")
    assert first.startswith("+49 ") and first.replace(" ", "") == second and "23456789" not in second
    assert len(new[4]) == len(texts[4]) and new[4] != texts[4] and new[4].endswith(".org now")
