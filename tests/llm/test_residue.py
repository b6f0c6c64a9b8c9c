"""Residue and what only speaks of it."""

from docuplane.llm import residue as R

BAD = [
    "Dear {{recipient_name}},\n\nthe harbour is open.", "The ${office.address} fee was paid.", "Notice: {% CLIENT %} harbour", "It was %amount_total% in all.", "Hello #first_name# again", "Seit «Empfänger» heute", "x <<dueDate>> y", "to __company__ now", "a @@case_number@@ b",
    "by &lt;signature&gt; today", "On [DATE] we met.", "[Insert name here] Memo", "was [TODO: amount] late", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Real words first.\nDolor sit magna aliqua commodo ipsum aliquip.",
    "404 Not Found\n\nThe requested page /warehouse/dg-1 was not found on this server.", "Harbour Records Portal\n\nSeite nicht gefunden\nDie Adresse /a/b-2 gibt es nicht mehr.\n\nHome | Search | Help", "Please enable JavaScript and cookies to continue.", "Veuillez activer JavaScript pour afficher ce document.",
    "Checking your browser before you proceed to /a/b-2. This takes up to 5 seconds.", "TBD\nTBD\nto be completed", "[object Object]", "asdf asdf qwer asdf", "xxxx xxxxx xx xxxx", "Untitled document\nClick here to add text", "502 Bad Gateway\nproxy v1.2", 'Traceback (most recent call last):\n  File "x.py", line 3, in page\nKeyError: \'body\'',
]
GOOD = [
    None, "", " \n ", "The harbour was closed.", "The mail merge puts the recipient where the template says {{recipient_name}}, and all 9 letters were checked.", "In the shell, ${HOME} and ${OUT_DIR} are expanded before the job reads it.", "The variable {{ title }} is explained on page 3 of the manual.",
    "Fields in [square brackets] are optional when it is submitted.", "The designer's draft still had lorem ipsum in 6 places, which the editor removed before printing.", "The amount was left as TBD in the first round and fixed at 6 in the second.",
    "Crawling stopped because 5 pages answered 404 Not Found; the list is in CR-1.", 'A log line such as "500 Internal Server Error" means that the proxy restarted; wait 9 seconds.', "Users asked why the portal tells them to enable JavaScript; the answer is in section 9.",
    "def f(x):\n    return {'n': 9, \"k\": [1, 2]}", "<|endoftext|>The harbour.<|endoftext|> [CLS] <s> </s>", "Il dit « bonjour » à tous.", "100% of 5% is 5%.", "word " * 20_000,
]


def test_cases(spark):
    rows = [(i, t, "h", True) for i, t in enumerate(BAD + GOOD)] + [(0, BAD[0], "h", True)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, is_notice boolean")
    got = sorted(r.doc_id for r in R.residue(df).collect())
    assert got == list(range(len(BAD)))
    assert R.without_residue(df).count() == len(GOOD) and R.residue_evidence(df).count() == len(rows)
    assert R.residue(df.limit(0)).count() == 0 and R.residue(df.drop("source")).count() == len(BAD)


def test_the_same_answer_for_many_addresses(spark):
    page = "Ressource /{}/{}-7 wurde umgezogen, bitte dort nachsehen wo sie nun liegt"
    rows = [(i, page.format(w, w), "h1" if i < 3 else "h2") for i, w in enumerate(["anchor", "barley", "copper", "depot"])] + [(9, page.format("anchor", "x") + " ganz anders", "h1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert sorted(r.doc_id for r in R.residue(df).collect()) == [0, 1, 2, 3]


def test_notices_within_real_text(spark):
    real = "The harbour was closed in the winter of 1907, and nine ships waited for the ice to break."
    bad = [
        f"{real}\n\nClick here to add text\n\n{real}", f"{real}\nMustertext für die zweite Spalte\n{real}", f"Quarterly results\nClick here to add text\n{real}", f"{real}\r\n\r\nPlease enable JavaScript and cookies to continue.\r\n", f"404 Not Found\n\n{real}",
        "Traceback (most recent call last):\n" + '  File "/srv/app/page.py", line 3, in page\n' * 200 + "KeyError: 'body'",
    ]
    good = [
        f"{real}\n\nUsers who open the list without scripts are told in a long banner to\nPlease enable JavaScript and cookies to continue.\n{real}", f"{real} The log says\npage not found for every\naddress of the old list.", f"{real}\nPage not found is the message\nthat readers of the old list were given.",
        "Users asked why the portal tells them to enable JavaScript; the answer is in section 9.\n\n" + real,
    ]
    df = spark.createDataFrame(list(enumerate(bad + good)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in R.residue_evidence(df).where("is_notice").collect()) == list(range(len(bad)))
