import re
from collections import Counter

from recollex.llm import licenses as li

from .helpers import docs, rows


def bag(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return Counter(zip(w, w[1:], strict=False))


def brute(texts, templates, threshold=0.8):
    best = {}
    for d, text in enumerate(texts):
        units = {text or "", *re.split(r"\n[ \t\r]*\n", text or ""), *(text or "").split("\n")}
        for unit in units:
            a = bag(unit)
            for name, t in templates:
                b = bag(t)
                if a and b:
                    dice = 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))
                    if dice >= threshold:
                        best[d, name] = max(best.get((d, name), 0), dice)
    return sorted((d, n, round(v, 9)) for (d, n), v in best.items())


MIT = dict(li.TEMPLATES[:1])["MIT"]
TEXTS = [
    "prose here\nReleased under the MIT License.\nmore prose", "released UNDER the mit license!!", MIT, "Copyright 2020 Me\n\n" + MIT.replace(" IN NO", "\nIN NO") + "\n\nprose of some length follows",
    MIT.replace("Software", "Program"), "Licensed under CC BY-SA 4.0.", "Licensed under CC BY 4.0", "of the and the of the in the", "", None, "License", "the software " * 3000, MIT + " " + MIT, "x\r\n \r\nThis work is licensed under the GNU General Public License, version 2.\r\n\r\ny",
]


def test_matches_brute_force(spark):
    found = li.detect(docs(spark, TEXTS).selectExpr("*", "1 as number", "2 as license", "3 as size", "4 as w"), li.templates_frame(spark))
    assert sorted((r["doc_id"], r["license"], round(r["dice"], 9)) for r in found.collect()) == brute(TEXTS, li.TEMPLATES)


def test_bounds_prune_without_loss_at_other_thresholds(spark):
    for t in (0.5, 0.95):
        found = li.detect(docs(spark, TEXTS), li.templates_frame(spark), threshold=t)
        assert sorted((r["doc_id"], r["license"], round(r["dice"], 9)) for r in found.collect()) == brute(TEXTS, li.TEMPLATES, t)


def test_odd_rows(spark):
    one = docs(spark, TEXTS[:1])
    assert rows(li.detect(one.union(one), li.templates_frame(spark)), "doc_id", "license") == [(0, "MIT")]
    assert li.detect(one.limit(0), li.templates_frame(spark)).count() == 0
    assert li.detect(one, li.templates_frame(spark).limit(0)).count() == 0
    null = one.selectExpr("cast(null as long) as doc_id", "text")
    assert rows(li.detect(null, li.templates_frame(spark)), "doc_id") == [(None,)]
