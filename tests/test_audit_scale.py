from pyspark.sql import functions as F

from shelfmark.operators import audit as A

MESSAGES = "sim string, pos long, role string, content string, error boolean, calls array<struct<name:string,args:map<string,string>>>"


def call(name, **args):
    return [{"name": name, "args": args}]


def rows(sim, said):
    return [
        (sim, 0, "assistant", None, False, call("find_user_id_by_email", email="x")), (sim, 1, "tool", None, False, None),
        (sim, 2, "assistant", None, False, call("get_order_details", order_id="O1")), (sim, 3, "tool", None, False, None),
        (sim, 4, "assistant", "Please confirm order O1", False, None), (sim, 5, "user", said, False, None),
        (sim, 6, "assistant", None, False, call("get_order_details", order_id="O1")), (sim, 7, "tool", None, False, None),
        (sim, 8, "assistant", None, False, call("cancel_pending_order", order_id="O1")), (sim, 8, "user", None, False, None), (sim, 9, "tool", None, False, None),
    ]


def test_only_messages_that_matter_are_ordered_for_confirmations(spark):
    df = spark.createDataFrame(rows("good", "yes, go ahead") + rows("bad", "hello") + [(None, 1, "user", "yes", False, None), ("good", 10, None, None, None, None)], MESSAGES)
    found = A.audit(df, block_size=3)
    kinds = {(r["sim"], r["violation"]) for r in found.collect()}
    assert ("bad", "write_without_explicit_confirmation") in kinds and ("good", "confirmation_not_bound_to_write_target") not in kinds
    # two messages stand at the write's place: both are looked up, so the write is judged once for each
    assert found.where("sim = 'bad' and violation = 'write_without_explicit_confirmation'").count() == 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(marked" in plan.replace(" ", "").lower()  # messages without a mark go before the windows
