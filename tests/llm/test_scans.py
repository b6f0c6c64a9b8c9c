"""Repairs by example and against text that was damaged on purpose."""

import random

from docuplane.llm import scans as S

WORDS = "harbour permit witness quarterly administrative orchard vessel conveyor timber insurer railway fertiliser magazine journal footer".split()


def clean(n, rng):
    return " ".join(["The", *(x for _ in range(n) for x in (rng.choice(WORDS), rng.choice(["was", "of", "under", "the"])))]) + "."


def pages_of(docs, seed=1):
    rng, rows, truth, key = random.Random(seed), [], set(), 0
    for d in range(docs):
        for p in range(1, 5):
            key += 1
            lines, n = [f"Annual orchard ledger {d}", ""], 2
            for _ in range(6):
                words = clean(5, rng).split()
                if rng.random() < 0.5:
                    i = rng.randrange(1, len(words) - 1)
                    w = words[i]
                    for a, b in (("er", "cr"), ("ar", "or"), ("d", "cl"), ("t", "+")):
                        if w in WORDS and a in w:
                            words[i] = w.replace(a, b, 1)
                            truth.add((key, n + 1, "glyph", w))
                            break
                lines.append(" ".join(words))
                n += 1
            w = rng.choice([x for x in WORDS if len(x) > 6])
            lines += [f"A {w[:4]}-", f"{w[4:]} under the permit.", "", f"            {p}"]
            truth.add((key, n + 1, "hyphen", w))
            truth |= {(key, 1, "furniture", ""), (key, n + 4, "furniture", "")}
            rows.append((key, f"d{d}", "i", "j1", p, "\n".join(lines), "clash"))
    return rows, truth


SCHEMA = "page_key bigint, doc_id string, index_name string, job_id string, page_no bigint, content string, lang string"


def test_damaged_text(spark):
    rows, truth = pages_of(30)
    rows += [(900, "e", "i", None, 1, None, ""), (901, "e", "i", None, 2, "", ""), (902, None, None, None, None, " \n ", ""), (903, "x", "i", "j1", 1, "~ _ .\n[3/9]", "")]
    jobs = spark.createDataFrame([("j1", "eng"), ("j1", "eng"), ("j2", None)], "job_id string, ocr_language string")
    got = {tuple(r) for r in S.repairs(spark.createDataFrame(rows, SCHEMA), jobs).collect()}
    mine = {g for g in got if g[0] < 900}
    assert len(mine & truth) / len(truth) > 0.97 and len(mine & truth) / len(mine) > 0.97
    assert {g for g in got if g[0] >= 900} == {(903, 1, "furniture", ""), (903, 2, "furniture", "")}


def test_empty(spark):
    assert S.repairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_broken_words():
    r = S.Repair({w: 100 for w in ["vineyard", "cluster", "railway", "the", "pipeline"]})
    assert r.whole("rail-", "way.") == "railway" and r.whole("vineyard-", "cluster,") == "vineyard-cluster" and r.whole("Kviso­", "kimoor") == "kvisokimoor"
    assert r.whole("vineyard-clu¬", "ster") == "vineyard-cluster" and r.whole("VM-", "53312") == "vm-53312" and r.whole("rai1-", "way") == "railway" and r.whole("x-", "") is None


def test_misread_words():
    r = S.Repair({"between": 500, "were": 900, "where": 800, "their": 300, "modem": 200, "form": 100})
    assert [r.token(t) for t in ("betwecn", "werc,", "mod0m", "modern.", "form", "Xyzzyq", "AB-123", "12")] == ["between", "were", "modom", "modem", None, None, None, None]
    assert r.token("betvveen") == "between" and r.token("Kvis0ki") == "kvisoki"


def test_context_picks():
    r = S.Repair({"cat": 100, "oat": 100, "the": 900}, {("the", "cat"): 50, ("an", "oat"): 40})
    assert r.word("(at", "the") == "cat" and S.language("der die und") == "de" and S.language("xyz", "fra+eng") == "fr" and S.language(None) == "en"


def test_furniture_lines():
    page = "Org | Title\n\nSome text that goes on here and there.\nMore of it until the end of the\n. ,  '\nPage 7 of 9"
    assert S.furniture(page, 7, {S.skeleton("Org | T1tle")}, 3) == {0, 4, 5}
    assert S.skeleton("Confidential railwoy appendlx 12") == S.skeleton("Confidential railway appendix 3")


def test_weighted_distance():
    cost = S.Repair.cost
    assert cost("harbour", "harbour") == 0 and cost("xyz", "xq") == 2 and cost("qz", "zq") == 1 and cost("", "ab") == 2
    assert cost("f6rderband", "förderband") == S.CONFUSIONS["6", "o"] + S.CONFUSIONS["o", "ö"] and abs(cost("decisi6n", "decisión") - S.CONFUSIONS["6", "o"] - S.ACCENT) < 1e-9
    assert abs(cost("kloseq", "klosed") - 1) < 1e-9 and abs(cost("clone", "done") - S.CONFUSIONS["cl", "d"]) < 1e-9 and cost("abcdefgh", "zyxwvuts", 1.0) == 9
    both = S.CONFUSIONS["rn", "m"] + S.CONFUSIONS["0", "o"]
    assert abs(cost("harrn0ny", "harmony") - both) < 1e-9


def test_misreadings_outside_the_table():
    tool = S.Repair({"harbour": 50, "the": 100, "breakwater": 40, "ledger": 30}, {("the", "harbour"): 20, ("the", "breakwater"): 9})
    held_out = {"harboxr": "harbour", "hxrbour": "harbour", "harbuor": "harbour", "breakwqter": "breakwater", "brekwater": "breakwater", "breakwwater": "breakwater"}
    assert {w: tool.word(w, "the") for w in held_out} == held_out
    assert tool.word("harboxr", "ledger") is None and tool.word("ledxer", "the") is None and tool.word("hxrbxur", "the") is None
