import pytest

from arbolex.plans import jobs
from arbolex.sources import conllu as co
from tests.test_conllu import word


def chain(n, root):
    lines = ["# made up"]
    for t in range(1, n + 1):
        head = 0 if t == root else t + 1 if t < root else t - 1
        tag = "VERB" if t == root else "NOUN" if t < root else "ADJ"
        lines.append(word(t, f"w{t}", tag, str(head), "root" if t == root else "obj" if t < root else "amod"))
    return "\n".join(lines) + "\n\n"


def test_vocabulary_and_language_model(spark, tmp_path):
    text = tmp_path / "t.txt"
    text.write_text("".join(f"the cat {w} here\n" for w in "abcd" * 20) + "\n")
    out = jobs.vocabulary_job(spark, str(text), str(tmp_path / "out"), size=4)
    assert out["word_vocab"].count() == 7
    assert out["coverage"].first().coverage == 100 * (3 * 80 + 20) / 320
    lm = jobs.language_model_job(spark, str(text), str(tmp_path / "out" / "vocab"), test=str(text))
    assert lm["batches"].count() == 80 // 25 * 6
    losses = lm["losses"].orderBy("ord").collect()
    assert [r["ord"] for r in losses] == [1, 2, 3] and all(0 < r.loss < 3 for r in losses)
    assert losses[2].avg_loss == pytest.approx(sum(r.loss for r in losses) / 3)
    chars = {(r.batch_no, r.step): r for r in lm["char_batches"].collect()}
    assert len(chars) == 80 // 25 * 6 and all(len(r.padded) == 25 and {len(p) for p in r.padded} == {r.width} for r in chars.values())
    assert chars[0, 1].width == len("<s>") + 2 and chars[0, 2].width == len("the") + 2
    ppl = lm["perplexity"].first()
    assert ppl.n_tokens == 320 and 1.0 < ppl.perplexity < 3.0


def test_parser_trains_scores_writes_and_reloads(spark, tmp_path):
    train, dev = tmp_path / "train.conllu", tmp_path / "dev.conllu"
    train.write_text("".join(chain(n, r) for n in range(1, 7) for r in range(1, n + 1)))
    dev.write_text(chain(5, 2) + chain(4, 4))
    model, written = str(tmp_path / "model"), str(tmp_path / "parsed")
    files = [str(train), str(dev)]
    out = jobs.parser_job(spark, files, output=written, save=model)
    assert out["las"][0] > 0.9 and out["las"][1] > 0.9
    assert out["quality"][0]["n_sent"] == 21
    again = co.read_conllu(spark, written)
    assert again.count() == 21
    loaded = jobs.parser_job(spark, [files[1]], load=model)
    assert loaded["las"] == [out["las"][1]]


def test_parser_in_epochs_keeps_the_best_model_and_writes_the_curve(spark, tmp_path):
    train = tmp_path / "train.conllu"
    train.write_text("".join(chain(n, r) for n in range(1, 6) for r in range(1, n + 1)))
    words = [f"w{t}" for t in range(1, 6)] + ["<unk>"]
    vectors = spark.createDataFrame([(w, [float(i), 1.0]) for i, w in enumerate(words)], "word string, vec array<float>")
    model = str(tmp_path / "model")
    out = jobs.parser_job(spark, [str(train)], save=model, epochs=3, max_iter=8, beam=2, vectors=vectors)
    curve = spark.read.parquet(f"{model}/curve").orderBy("epoch").collect()
    assert [r.epoch for r in curve] == [0, 1, 2, 3] and curve[-1].best_score == max(r.score for r in curve) > curve[0].score
    assert out["las"][0] > 0.5
    again = jobs.parser_job(spark, [str(train)], load=model, beam=2, vectors=vectors)
    assert again["las"] == out["las"]
