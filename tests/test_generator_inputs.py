from steadfetch.operators import rewrites
from steadfetch.plans import question_queries


def test_fallback_counters_send_the_model_its_inputs_only(spark, small, monkeypatch):
    asked, real = [], rewrites.apply_batches

    def seen(df, fn, name, **how):
        asked.append(how.get("inputs"))
        return real(df, fn, name, **how)

    monkeypatch.setattr(rewrites, "apply_batches", seen)
    rows = {r["perturbation_type"]: r for r in question_queries.fallbacks(spark, small).collect()}
    # Long prompts and lists of answers stay where they are.
    assert asked and all(i is not None and not {"prompt", "all_answers"} & set(i) for i in asked)
    # Every tenth question is never answered.
    assert all(rows[t]["n_rows"] > rows[t]["n_fallback"] >= rows[t]["n_rows"] // 10 > 0 for t in (1, 2, 3))
