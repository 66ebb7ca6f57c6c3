"""Words, products and evidence of the toxicity operator, against plainer ways."""

import random

import numpy as np

from gigledger.llm import toxicity


def test_plain_texts_have_the_words_of_the_expression():
    r = random.Random(1)
    signs = [chr(c) for c in range(128)] + ["é", "İ", "ß", " ", "٣"]
    for n in range(400):
        text = "".join(r.choice(signs[:256] if n % 2 else signs) for _ in range(r.randrange(60)))
        assert toxicity.words_of(text) == toxicity.WORDS.findall(text.lower())
    assert toxicity.words_of(None) == toxicity.words_of("") == []


def test_products_and_evidence_equal_dense_ones():
    r = np.random.default_rng(2)
    dense = np.where(r.random((90, 40)) < 0.3, r.random((90, 40)), 0.0)
    owner, terms = np.nonzero(dense)
    index = toxicity.BlockMaxIndex(np.arange(90), owner, terms, dense[owner, terms], 40)
    mine = np.array([1, 5, 9, 30])
    weights = np.array([0.1, 0.4, 0.3, 0.2])
    places = np.array([0, 7, 8, 89])
    assert np.allclose(index._products(places, mine, weights), dense[index.order[places]][:, mine] @ weights)
    assert len(index._products(places[:0], mine, weights)) == 0
    held = {t for t in mine.tolist() if dense[index.order[7], t] > 0}
    assert index.shared_terms(7, mine, weights) == [t for t in (5, 9, 30, 1) if t in held]
    assert not index.query.any()
