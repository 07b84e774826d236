"""JSON text of match documents, with the spacing and nulls that prompts are cut by, and reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from roundsmith.functions.scalar import rendered


def json_string(text: Column) -> Column:
    """A JSON string that keeps characters beyond ASCII."""
    quoted = F.to_json(F.struct(text.alias("s")))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(quoted, 6, F.length(quoted) - 6))


def json_number(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("null"))


def json_bool(x: Column) -> Column:
    return F.when(x.isNull(), "null").when(x, "true").otherwise("false")


def json_flag(x: Column) -> Column:
    """A boolean that is written as a number."""
    return F.when(x.isNull(), "null").when(x, "1").otherwise("0")


def json_object(**fields: Column) -> Column:
    parts: list[Column] = []
    for k, (name, value) in enumerate(fields.items()):
        parts += [F.lit(("{" if not k else ", ") + f'"{name}": '), value]
    return F.concat(*parts, F.lit("}"))


def json_array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def _xyz(a: Column) -> Column:
    return json_array(F.transform(a, json_number))


def _name(x: Column) -> Column:
    return json_string(rendered(x))


def match_json(match_id: Column, map_name: Column, rounds: Column) -> Column:
    """The text of a nested match document: a space after each comma and colon, null names as None."""

    def kill(k: Column) -> Column:
        where = json_object(victim_xyz=_xyz(k["location"]["victim_xyz"]), killer_xyz=_xyz(k["location"]["killer_xyz"]))
        return json_object(tick=json_number(k["tick"]), killer=_name(k["killer"]), victim=_name(k["victim"]), weapon=_name(k["weapon"]), is_headshot=json_flag(k["is_headshot"]), is_first_kill=json_bool(k["is_first_kill"]), location=where)

    def grenade(g: Column) -> Column:
        return json_object(tick=json_number(g["tick"]), type=json_string(g["type"]), thrower=_name(g["thrower"]), detonation_xyz=_xyz(g["detonation_xyz"]))

    def blind(b: Column) -> Column:
        return json_object(tick=json_number(b["tick"]), victim=_name(b["victim"]), attacker=_name(b["attacker"]), blind_duration=json_number(b["blind_duration"]))

    def plant(p: Column) -> Column:
        return json_object(tick=json_number(p["tick"]), planter=_name(p["planter"]), site=_name(p["site"]))

    def one(r: Column) -> Column:
        lists = {n: json_array(F.transform(r[n], f)) for n, f in (("kills", kill), ("grenades", grenade), ("flash_blinds", blind), ("plants", plant))}
        return json_object(round_number=json_number(r["round_number"]), winner=_name(r["winner"]), reason=_name(r["reason"]), **lists)

    return json_object(match_id=json_string(match_id), map_name=json_string(map_name), rounds=json_array(F.transform(rounds, one)))


def advice_log(task_id: Column, match_id: Column, map_name: Column, advice: Column) -> Column:
    """An entry of the advice log."""
    line = "=" * 60
    return F.concat_ws("\n", F.lit(line), F.concat(F.lit("TASK: "), rendered(task_id), F.lit(" | MATCH: "), rendered(match_id), F.lit(" | MAP: "), rendered(map_name)), F.lit(line), advice, F.lit(""))


def local_log(match_id: Column, map_name: Column, n_rounds: Column, analyst: Column, coach: Column) -> Column:
    """An entry of the local log, with both reports."""
    line = F.lit("=" * 70)
    head = F.concat(F.lit("MATCH: "), rendered(match_id), F.lit(" | MAP: "), rendered(map_name), F.lit(" | ROUNDS: "), rendered(n_rounds))
    return F.concat_ws("\n", line, head, line, F.lit("[ANALYST]"), analyst, F.lit("[COACH]"), coach, F.lit(""))
