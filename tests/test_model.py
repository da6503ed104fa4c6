import numpy as np

from pathloom.config import ModelConfig
from pathloom.model import mln
from pathloom.model.scorer import Scorer, train


def test_exact_partition_of_two_facts():
    # a => b with weight 1: three of four worlds satisfy it
    assert np.isclose(mln.exact_log_partition([1.0], [([0], 1)], 2), np.log(3 * np.e + 1))
    assert np.isclose(mln.sampled_log_partition(np.array([1.0]), [([0], 1)], 2, 20000), np.log(3 * np.e + 1), atol=0.02)


def test_fit_raises_the_head_of_a_true_body():
    ground = [([0, 1], 2)]
    out = mln.fit([0], ground, np.array([True, True, False]), 1, epochs=8)
    assert out.q[2] > 0.5 and len(out.history) >= 3 and np.isfinite(out.history).all()
    assert mln.gibbs(np.array([3.0]), ground, np.array([True, True, False]))[:2].all()


def test_gradients_against_differences():
    s = Scorer.fresh(["a", "b", "c"], ["r"], ModelConfig(embedding_dim=3, hidden=4), 1)
    h, r, t = np.array([1, 2]), np.array([1, 1]), np.array([2, 3])
    error = np.array([0.7, -0.2])
    logits, held = s.forward(h, r, t)
    exact = s.gradients(h, r, t, error, held)
    for name, x in s.tensors.items():
        for k in list(np.ndindex(x.shape))[:: max(1, x.size // 5)]:
            was, eps = x[k], 1e-6
            x[k] = was + eps
            up = error @ s.forward(h, r, t)[0]
            x[k] = was - eps
            down = error @ s.forward(h, r, t)[0]
            x[k] = was
            assert np.isclose(exact[name][k], (up - down) / (2 * eps), atol=1e-5)


def test_scorer_tells_facts_from_corruptions(spark):
    known = spark.createDataFrame([(f"e{i}", f"r{k}", f"e{(i + k + 1) % 40}") for i in range(40) for k in range(2)], "src string, rel string, dst string")
    scorer = train(known, ModelConfig(embedding_dim=16, hidden=24, epochs=60))
    good = scorer.score(known).agg({"confidence": "avg"}).first()[0]
    bad = scorer.probabilities([f"e{i}" for i in range(40)], ["r0"] * 40, [f"e{(i + 17) % 40}" for i in range(40)]).mean()
    assert good > 0.8 and bad < 0.3
    again = Scorer.from_document(scorer.to_document())
    assert again.probabilities(["e1"], ["r0"], ["e2"])[0] == scorer.probabilities(["e1"], ["r0"], ["e2"])[0]


def test_temperature():
    x = np.array([4.0, 4.0, -4.0, 4.0])
    assert np.log1p(np.exp(mln.calibrate_temperature(x, np.array([1.0, 1.0, 0.0, 0.0])))) > 1
