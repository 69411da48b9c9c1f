"""Block queries over whole documents, against plain Python: no text is cut before its tokens count."""

import random
import re

from siltstone.operators import fusion
from siltstone.plans.queries import QUERIES, _blocks


def estimate(text):
    cjk = len(re.findall("[一-鿿]", text))
    return (3 * cjk + 2 * len(re.findall("[a-zA-Z]+", text)) + len(re.findall("[0-9]+", text))) // 2 + 1


def test_blocks_are_of_whole_documents(spark, tmp_path):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(["word", "12", "检", "x"]) for _ in range(n))
    # block 0 is small; block 1 fits only if cut; block 2 fits whole, though a document is longer than 2000 characters
    sizes = [5, 9, 0, 30, 900, 900, 300, 300, 800, 3, 3, 3]
    texts = {k: words(n) for k, n in enumerate(sizes)}
    frame = spark.createDataFrame([(k, t, "en", "src1") for k, t in texts.items()], "doc_id bigint, text string, lang string, source string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    tokens = {b: sum(estimate(texts[k]) for k in range(4 * b, 4 * b + 4)) for b in range(3)}
    cut = {b: sum(estimate(texts[k][:2000]) for k in range(4 * b, 4 * b + 4)) for b in range(3)}
    assert tokens[1] > 2000 >= cut[1] and 2000 >= tokens[2] > cut[2]

    got = {r.block_id: (r.tokens, r.promotable) for r in QUERIES["block_promotable"](spark, str(tmp_path)).collect()}
    assert got == {b: (n, n <= 2000) for b, n in tokens.items()}

    hits = spark.createDataFrame([(1, 1, 8, 0.9), (1, 2, 4, 0.8), (1, 3, 9, 0.7)], "query_id int, rank int, chunk_id bigint, score double")
    got = fusion.promote(hits, _blocks(spark, str(tmp_path))).orderBy("rank").collect()
    whole = "\n\n".join(texts[k] for k in range(8, 12))
    assert [(r.chunk_id, r.promoted, r.content, r.tokens, r.original_tokens) for r in got] == [(8, True, whole, estimate(whole), estimate(texts[8])), (4, False, texts[4], estimate(texts[4]), estimate(texts[4]))]
