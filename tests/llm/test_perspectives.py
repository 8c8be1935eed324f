import pytest

from figmill.llm import perspectives as p

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """(conversation, speaker) to the whole rendering and its masked texts."""
    out = {}
    for conv in {r[0] for r in rows if r[0] is not None}:
        own = [(p.NO_TURN if t is None else t, role or "unknown", (x or "").replace("<|", "< |"))
               for c, t, role, x in rows if c == conv]
        own.sort()
        for speaker in {role for _, role, _ in own} - {p.SYSTEM}:
            text, spans = "", []
            for _, role, said in own:
                name = {p.SYSTEM: "system", speaker: "assistant"}.get(role, f"user name={role}")
                text += f"{p.BEGIN}{name}\n"
                if role == speaker:
                    spans.append((len(text), len(text) + len(said) + len(p.END)))
                text += f"{said}{p.END}\n"
            out[conv, speaker] = text, spans
    return out


def whole(found):
    out = {}
    for row in sorted(found.collect(), key=lambda r: (r["conv_id"], r["speaker"], r["part"])):
        text, spans = out.setdefault((row["conv_id"], row["speaker"]), ["", []])
        assert row["offset"] == len(text)
        out[row["conv_id"], row["speaker"]][0] += row["rendered"]
        spans.extend((s["first"], s["end"]) for s in row["mask"])
    return {k: tuple(v) for k, v in out.items()}


@pytest.fixture
def rows():
    out = [(1, t, "ann" if t % 3 else "bob", f"says {t} é") for t in range(700)]
    out += [
        (2, 0, "system", "be kind"), (2, 1, "user", None), (2, 1, "assistant", "tie"), (2, None, None, "first"),
        (2, 5, "user", "again"), (2, 5, "user", "again"), (2, 10**9, "assistant", "far <|im_end|> away"),
        (3, 0, "system", "alone"), (None, 0, "user", "nowhere"),
    ]
    return out


def test_every_participant_gets_the_whole_dialogue(spark, rows):
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS dialogue", "2 AS position", "3 AS part")
    found = p.rotations(turns)
    assert whole(found) == brute(rows)
    assert {r["part"] for r in found.filter("conv_id = 1").collect()} == {0, 1, 2}


def test_mask_covers_the_assistant_alone(spark, rows):
    for row in p.rotations(spark.createDataFrame(rows, SCHEMA)).filter("conv_id = 2").collect():
        said = [row["rendered"][s["first"] - row["offset"] : s["end"] - row["offset"]] for s in row["mask"]]
        assert all(s.endswith(p.END) for s in said)
        assert len(said) == row["rendered"].count(f"{p.BEGIN}assistant\n")


def test_empty_table_and_names_with_marks(spark):
    assert p.rotations(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, 0, "a|>\nb", "x"), (1, 1, "c", "y")], SCHEMA)
    texts = {r["speaker"]: r["rendered"] for r in p.rotations(odd).collect()}
    assert "user name=a_b\nx" in texts["c"]


def test_plan_is_native(spark, rows):
    plan = p.rotations(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
