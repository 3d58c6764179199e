"""The bounds of learning are parameters of score."""

from graphmill.llm import toxicity
from tests.llm.helpers import docs_of

LABELS = "doc_id long, quality int, toxic int"


def test_bounds_reach_learning(spark, monkeypatch):
    made = []

    def machine(alphabet, landmarks, words, y, weight, real=toxicity.Machine):
        made.append((landmarks, [w for w, label in zip(words, y, strict=True) if label > 0], words))
        return real(alphabet, landmarks, words, y, weight)

    monkeypatch.setattr(toxicity, "Machine", machine)
    bad, good = ["pathetic", "idiot", "loser"], "you see the weather is fine and the river runs. "
    rows = [(i, f"you {bad[i // 3 % 3]} number{i}. " if i % 3 == 0 else f"{good}word{i}. ") for i in range(120)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)], LABELS)
    toxicity.score(docs, labels).collect()
    assert len(made) == toxicity.ROUNDS and set(made[0][1]) == {toxicity.edged(w) for w in bad}
    made.clear()
    toxicity.score(docs, labels, sentences=1, toxic_marks=2, clean_marks=1, hard_words=1, rounds=2).collect()
    assert len(made) == 2 and len(made[0][0]) == 3 and len(made[0][1]) == 1
    assert len(made[1][2]) <= len(made[0][2]) + 1


def test_sentences_are_not_halved():
    assert toxicity.SENTENCES == 20_000
