"""Paragraphs without any word of the training sample's gate are read too."""

import re

from fieldweave.llm import license_scan


def test_reworded_notice_without_gate_words_is_unknown(spark):
    notice = "Permission is granted, free of charge, to any one obtaining a copy of this and associated files"
    assert not re.search(rf"(?i)\b(?:{'|'.join(license_scan.gate_words())})", notice)
    filler = [(k, f"the river runs along the green fields number {k} and people walk slowly there") for k in range(100, 160)]
    rows = [(1, notice), (2, f"some plain words\n\n{notice}\n\nmore plain words"), (3, "Released under the MIT License."), (4, "people walk along the river")]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows + filler, "doc_id long, text string")).collect()}
    assert [(got[k]["n_unknown"], got[k]["n_licensed"], got[k]["licence"]) for k in range(1, 5)] == [(1, 0, "unknown"), (1, 0, "unknown"), (0, 1, "mit"), (0, 0, "none")]
