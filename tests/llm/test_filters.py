"""Operators 3 to 6 against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import random
import re
import tracemalloc

import numpy as np
import regex
from pyspark.sql import functions as F

from roadloom.llm.chat_windows import chat_windows, read_back
from roadloom.llm.multi_pattern import Searchers, WuManber, mark_benchmark_words, words_of
from roadloom.llm.quality_rules import judge_quality, with_base_counts
from roadloom.llm.url_filter import _bits, bloom_blocks, canonical, judge_urls, passing

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def test_wu_manber_finds_what_comparison_finds():
    rng = random.Random(3)
    for _ in range(300):
        m = rng.randrange(1, 6)
        patterns = {tuple(rng.randrange(1, 4) for _ in range(m)): (i,) for i in range(rng.randrange(1, 6))}
        words = [rng.randrange(5) for _ in range(rng.randrange(0, 40))]
        found = WuManber(np.array(list(patterns), np.int64), list(patterns.values()), [])
        got = list(found.search(words, np.array(words, np.int32).tobytes()))
        assert got == [(i, patterns[tuple(words[i : i + m])]) for i in range(len(words) - m + 1) if tuple(words[i : i + m]) in patterns]


def test_tables_take_what_the_docstring_says():
    rng = random.Random(9)
    items = [(i, " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(500))) for i in range(300)]  # 1 MB of words that hardly recur
    tracemalloc.start()
    kept = Searchers(items, 10)
    now, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    size = sum(len(t) for _, t in items)
    assert kept.search(items[7][1])[2] == {"7"} and now < 80 * size and peak < 160 * size


def test_words_are_as_the_pattern_says():
    text = "".join(map(chr, range(0x180))) + "Ünï 中文 a1B2"
    assert words_of(text) == [w.encode() for w in WORDS.findall(lower(text))]


def brute_hits(text, items, window=10):
    words, hit, found = WORDS.findall(lower(text)), set(), set()
    for item_id, item in items:
        w = WORDS.findall(lower(item))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == w[i : i + size]:
                    hit |= set(range(j, j + size))
                    found.add(str(item_id))
    return len(words), len(hit), sorted(found)


def test_benchmark_words_in_one_and_many_blocks(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 10, 25])))) for i in range(12)] + [(12, None), (3, "Twice the same"), (13, "")]
    docs = [(i, " ".join([*rng.choices(vocabulary, k=20), (items[i % 12][1]).upper(), "x" * (i % 3)]), "a", "b") for i in range(30)]
    docs += [(0, None, "a", "b"), (1, "", "a", "b"), (2, "same, THE  twice the-same", "a", "b"), (2, "same, THE  twice the-same", "a", "b"), (3, "w1 " * 30000, "a", "b")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, items string, n_hit string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 200):
        got = mark_benchmark_words(frame, bench, block_bytes=size).collect()
        assert len(got) == len(docs)
        for r in got:
            assert (r.n_words, r.n_hit, r["items"]) == brute_hits(r.text, items)
            assert sum(s.end - s.start for s in r.hit_spans) == r.n_hit
    assert mark_benchmark_words(frame.limit(0), bench).count() == 0
    assert all(r.n_hit == 0 for r in mark_benchmark_words(frame, bench.limit(0)).collect())
    assert Searchers([], 10).by_length == []


def brute_base(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark):
    rng = random.Random(7)
    texts = [None, "", " ", "\n\n", "a", "a b", "a b c", "a a a a", "\x85 x\x0by", "|#| é\n|#| é\n\t\n\t\n"]
    texts += ["".join(rng.choice(["a", "b", "é", " ", "\n", "|", "\t"]) for _ in range(rng.randrange(60))) for _ in range(200)] + ["ab " * 500]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = with_base_counts(spark.createDataFrame(rows, "doc_id long, text string, n_words string")).collect()
    for r in got:
        want = brute_base(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.text
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_rules_adapt_by_group_and_keep_clean_text(spark):
    rng = random.Random(11)
    prose = lambda: " ".join("".join(rng.choices("abcdef", k=rng.randrange(2, 9))) for _ in range(120))
    rows = [(i, prose(), rng.choice(["en", None]), f"s{i % 3}") for i in range(900)]
    rows += [(1000 + i, prose().replace(" ", "|| "), "en", "s0") for i in range(60)]  # junk
    rows += [(2000 + i, prose().replace(" ", "|| "), "xx", "tables") for i in range(300)]  # a source of nothing else
    rows += [(3000, None, None, None), (3001, "", "en", "s1"), (5, rows[5][1], rows[5][2], rows[5][3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"kept": docs_true(), "n_words": docs_true()})
    got = judge_quality(docs, ["doc_id", "text", "lang", "source"]).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(900))
    assert not any(kept[1000 + i] for i in range(60))
    assert all(kept[2000 + i] for i in range(300))
    assert not kept[3000] and not kept[3001]
    assert judge_quality(docs.limit(0), ["doc_id"]).count() == 0


def docs_true():
    return F.lit(True)


def test_chat_windows_round_trip(spark):
    rng = random.Random(13)
    odd = ["</s>[INST] ok [/INST]", "<|user|>\nx<|end|>\n", "\\l \\s \\", "", None, "é 中 " * 5, "|[<"]
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 14)):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "assistant", "system", "a|<b", None])
            rows.append((c if c else None, t if c % 7 else t // 2, role, rng.choice(odd) if rng.random() < 0.4 else "w " * rng.randrange(60), "x"))
    rows += [(900, t, "assistant" if t % 2 else "user", "word " * 10, "x") for t in range(400)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    budget, history = 100, 30
    windows = chat_windows(frame, budget, history)
    back = {r.conv_id: r for r in read_back(windows).collect()}
    by_conv = {}
    for c, t, role, text, _ in rows:
        by_conv.setdefault(c, []).append((t, role or "", text or ""))
    assert set(back) == set(by_conv)
    for c, turns in by_conv.items():
        turns.sort()
        assert [(t.role, t.text) for t in back[c].turns] == [x[1:] for x in turns]
        assert back[c].loss_text == "".join(x for _, r, x in turns if r == "assistant")
    tokens = lambda x: len(regex.findall(r"\p{L}{1,6}|\p{N}{1,3}|[^\s\p{L}\p{N}]", x)) + 4
    for w in windows.collect():
        if w.n_tokens > budget:
            new = [x for _, _, x in by_conv[w.conv_id]]
            assert max(map(tokens, new)) > budget - history - 70
        system = by_conv[w.conv_id][0][1] == "system"
        assert not system or w.formatted.startswith("<|system|>\n")
    many = [w for w in windows.collect() if w.conv_id == 900]
    assert len(many) > 10 and all(w.n_repeated == 2 for w in many if w.window) and max(w.n_tokens for w in many) <= budget
    assert chat_windows(frame.limit(0)).count() == 0
    full = [w for w in many if w.formatted.count("<|end|>") == 7]  # two turns of history and five that fit; the end of a page cuts some short
    assert len(full) > 0.8 * len(many)


def test_one_conversation_of_many_turns(spark):
    """8,000 turns of 60 words in one conversation, each as brute force formats it."""
    turns = spark.range(8000).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id = 0 THEN 'system' WHEN id % 2 = 0 THEN 'assistant' ELSE 'user' END AS role", "repeat(concat('word', id, ' '), 60) AS text")
    windows = chat_windows(turns)
    (back,) = read_back(windows).collect()
    assert [(t.role, t.text) for t in back.turns] == [("system" if i == 0 else "user" if i % 2 else "assistant", f"word{i} " * 60) for i in range(8000)]
    assert back.loss_text == "".join(f"word{i} " * 60 for i in range(2, 8000, 2))
    assert max(r.n_tokens for r in windows.select("n_tokens").collect()) <= 512


def test_url_rules_and_list(spark):
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    urls = ["http://A.Example.net/en/x?y#z", "http://example.net/de/x", "x://net", "https://net/", "http://anet/", None, "no scheme", "://", "http://sub.example.com/de/", "http://example.com/de", "HTTP://Q.org/fr/a", "http://q.org/a/", "https://www.q.org/a/index.html?utm_source=f&ref=1#t", "http://q.org/a?b=2&a=1", "http://q.org/b://c/d", "http://q.org/a/"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame([("http://Q.org/a",), ("http://q.org/a/#x",), (None,), ("",), ("http://example.net/en/x?y",)], "url string")
    got = {r.page_id: r for r in judge_urls(pages, listed, rules).collect()}
    assert len(got) == len(urls)
    say = lambda i: (got[i].host, got[i].path, got[i].rule, got[i].verdict)
    assert say(0) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert say(1) == ("example.net", "/de/x", "net/", "block")
    assert say(2) == ("net", "", None, "allow")
    assert say(3) == ("net", "/", "net/", "block")
    assert say(4) == ("anet", "/", None, "allow")
    assert say(5) == say(6) == say(7) == ("", "", None, "allow")
    assert say(8)[2:] == ("example.com/de/", "block") and say(9)[2:] == (None, "allow") and say(10)[2:] == ("org/fr/", "allow")
    assert [got[i].verdict for i in (11, 12, 13, 15)] == ["block", "block", "allow", "block"]
    assert say(14)[:2] == ("q.org", "/b://c/d")
    assert all(r.verdict == "allow" or r.rule for r in judge_urls(pages, listed.limit(0), rules).collect())
    assert judge_urls(pages.limit(0), listed, rules).count() == 0


def test_filter_passes_every_listed_url_and_few_others(spark):
    listed = spark.range(2000).selectExpr("concat('http://h.org/', id) AS url")
    pages = spark.range(4000).selectExpr("id AS page_id", "concat('https://h.org/', id, '/') AS url")
    got = judge_urls(pages, listed, []).toPandas()
    assert (got["listed"] == (got["page_id"] < 2000)).all()
    known = listed.select(canonical(F.col("url")).alias("canonical"))
    n_blocks = 2000 * 16 // 512
    h, masks = _bits(F.col("canonical"))
    blocks = bloom_blocks(known, n_blocks)
    assert blocks.count() <= n_blocks
    seen = pages.select("page_id", canonical(F.col("url")).alias("canonical")).withColumn("block", F.pmod(h, F.lit(n_blocks)))
    passed = {r.page_id for r in seen.join(blocks, "block", "left").where(passing(masks)).collect()}
    assert passed >= set(range(2000)) and len(passed) < 2000 + 40
