import pytest

from shardwright.llm import html_crf

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("outer", ["", "home blog single logged in admin bar custom logo theme wide layout grid container fluid dark mode sticky no js desktop "
                                       "template default post type archive category news language english group builder kit"])
def test_own_container_is_seen(spark, outer):
    """Class words of outer elements, however many, leave the block's own."""
    body = "This is the first long sentence of the article, with many words. And here is another one, just as plain."
    page = (f"<html><body class='{outer}'><main><article><h1>The event</h1><p>{body}</p><p>{body}</p></article></main>"
            f"<div><div class=comment>I agree with all of this very much indeed, friend.</div><div class=sidebar>Read all of the other news of this week here.</div></div></body></html>")
    model = html_crf.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = html_crf.extract(spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string"), model).first()
    assert got.text == f"The event\n{body}\n{body}"


def test_every_name_is_a_feature():
    outer = " ".join(f"w{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}" for k in range(60))
    weights = html_crf.np.zeros((html_crf.DIM, 2), html_crf.np.float32)
    weights[html_crf._index("k:comment"), 0] = 5
    page = html_crf.html_blocks.blocks(f"<body class='{outer}'><div class=comment>one</div><div class=story>two</div>")
    (labels,) = html_crf.viterbi([html_crf.page_features(page)], weights + [[0, 1e-3]], html_crf.np.zeros((2, 2)))
    assert labels.tolist() == [0, 1]
