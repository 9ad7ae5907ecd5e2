"""What naive Bayes and bigrams take from a text, against plain loops; measures alone equal those among all facts."""

import math
import re
from collections import Counter

import pytest

from lodemark.operators import bayes, source
from lodemark.plans import registry
from lodemark.plans.samples import CODE

TEXTS = ["", "Result_of = await fetchUserData2(x9) # é 3d __a HTTPServer const var", "a_b c a b_c\na_b c", "one two one two one", *(c for _, _, c in CODE)]


@pytest.mark.parametrize("text", TEXTS)
def test_told(text):
    ascii_ = lambda p: re.findall(p, text, re.A)
    tokens = [w.lower() for w in ascii_(r"\w+") if len(w) > 1]
    pairs = Counter("_".join(tokens[k : k + 2]) for k in range(len(tokens) - 1))
    spaced = re.sub("([a-z0-9])([A-Z])", r"\1_\2", re.sub("([A-Z]+)([A-Z][a-z])", r"\1_\2", "_".join(ascii_(r"\b[a-zA-Z_]\w*\b"))))
    parts = [x for x in re.split("_+", spaced.lower()) if len(x) >= 2]
    words = [len(ascii_(r"\b(?:" + "|".join(k) + r")\b")) for k in (bayes.KEYWORDS, bayes.HUMAN_KEYWORDS)]
    weight = sum(ai - human for x in parts for human, ai in [bayes.SUBTOKENS.get(x, (0, 0))])
    want = (len(ascii_(r"\w+")), *words, len(parts), weight, len(tokens), len(pairs), sum(n * math.log2(n) for n in pairs.values()))
    assert bayes.told(text) == pytest.approx(want)


@pytest.mark.parametrize("lang, code", [(x, "Words before (the) code.\nIf x ? y : z\n" + c) for _, x, c in CODE])
def test_measures_alone(lang, code):
    assert source.describe(code, lang, whole=False) == {"measures": source.describe(code, lang)["measures"]}


@pytest.mark.parametrize("name", ["nb_score", "bigrams"])
def test_no_fold_over_words_in_columns(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "lambda" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
