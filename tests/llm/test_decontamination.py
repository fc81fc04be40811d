"""Short items in any script, against search character by character."""

import unicodedata

import pytest

from quillspark.llm.decontamination import contamination, keep_clean

ITEMS = ["答えは四十二", "สวัสดีครับ", "四十二", "ответ 42", "مرحبا", "naïve", "x=1"]
TEXTS = [
    "彼は言った、答えは四十二です。", "答えは四十三です", "เขาพูดว่าสวัสดีครับทุกคน", "сказал: ответ 42!", "ответ 421", "неответ 42", "قال «مرحبا» ثم", "يامرحبا", "naïve", "naïvely", "“Naïve” — so", "if x=1: pass", "max=1", "x=12",
    "", None, "四十 二", "42四十二x", "\u00a0مرحبا\u00a0", "…naïve…",
]


def goes_on(c: str) -> bool:
    name = unicodedata.name(c, "")
    return c.isalnum() and not name.startswith(("CJK", "HIRAGANA", "KATAKANA", "THAI"))


def held(item: str, text: str) -> bool:
    item, text = " ".join(item.lower().split()), " ".join((text or "").lower().split(" "))
    at = text.find(item)
    while at >= 0:
        before = at > 0 and goes_on(text[at - 1]) and goes_on(item[0])
        end = at + len(item)
        after = end < len(text) and goes_on(text[end]) and goes_on(item[-1])
        if not before and not after:
            return True
        at = text.find(item, at + 1)
    return False


@pytest.mark.parametrize("names", [[], ["item_ids", "contaminated"]])
def test_short_items_in_any_script(spark, names):
    schema = "doc_id long, text string" + "".join(f", {x} string" for x in names)
    docs = spark.createDataFrame([(i, t, *names) for i, t in enumerate(TEXTS)] * 2, schema)
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    want = {i: [k for k, x in enumerate(ITEMS) if held(x, t)] for i, t in enumerate(TEXTS)}
    got = contamination(docs, bench).collect()
    assert len(got) == 2 * len(TEXTS) and {x.doc_id: list(x.item_ids) for x in got} == want
    assert want[0] == [0, 2] and want[1] == [] and want[4] == [] and want[17] == [2]
    assert sorted(x.doc_id for x in keep_clean(docs, bench).collect()) == sorted([i for i in want if not want[i]] * 2)


def test_long_text(spark):
    text = "色は匂へど" * 300_000 + "答えは四十二" + "散りぬるを" * 300_000
    docs = spark.createDataFrame([(1, text), (2, text.replace("四", "三")), (None, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "答えは四十二"), (None, "色")], "item_id long, text string")
    assert sorted((x.doc_id or 0, list(x.item_ids)) for x in contamination(docs, bench).collect()) == [(0, [5]), (1, [5]), (2, [])]
