"""Contract cases: pages with broken markup, ids of special tokens."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from voxelspark.llm import html_blocks, queries


@pytest.mark.parametrize("tag", "button select object svg canvas audio video noscript template math".split())
def test_tags_without_end_drop_no_text(tag):
    texts = lambda page: [b.text for b in html_blocks.blocks(page)]
    assert texts(f"<article><p>a</p><{tag}>x<p>b</p></article><p>c</p>") == ["a", "x", "b", "c"]
    assert texts(f"<p>a</p><{tag}>x<p>b</p><{tag}>y</{tag}><p>c</p>") == ["a", "x", "b", "c"]
    assert texts(f"<p>a</p><{tag}>x<!-- </{tag}> --><script>'</{tag}>'</script></{tag}><p>b</p>") == ["a", "b"]


def test_raw_text_without_end_runs_to_the_end():
    for tag in ("script", "style", "textarea", "title", "iframe"):
        assert [b.text for b in html_blocks.blocks(f"<p>a</p><{tag}>x<p>b</p>")] == ["a"]
    assert [b.text for b in html_blocks.blocks("<p>a</p><iframe src='x'/><svg><text>q</text></svg><p>b</p>")] == ["a", "b"]


def test_packed_ids_are_those_of_the_plain_call(spark, tmp_path):
    import corpus_pipeline

    texts = ["end <|endoftext|> of", "<|endoftext|><|endoftext|>x", "<|endoftext", "plain text", "a\n<|endoftext|>\n" * 600, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    plain = Tokenizer.from_file(queries.public_tokenizer("byte_bpe_50k.json"))
    assert plain.encode(texts[0], add_special_tokens=False).ids == [437, 220, 50256, 286]
    want = []
    for i, text in enumerate(texts):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    for out in (queries.op10_linear_grouping_packing(spark, str(tmp_path)), dict(corpus_pipeline.STAGES)["packing"](spark, df, "")):
        assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out.collect()) == want
