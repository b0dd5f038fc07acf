"""A query for each corpus recipe, over tables of the corpora's shapes made of the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chat, recipes
from .oracle import PAIRS, last, seeded, strip, tokens, words

SEED = 3


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _none() -> Column:
    return F.array().cast("array<string>")


# --- the corpora's shapes ---


def _dialogues(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "ift_data_pwc").where("conversations is not null").withColumnRenamed("item_id", "pos")


def _examples(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "split_examples").where("question is not null").withColumnRenamed("example_id", "pos")


def marco_v1(s, d):
    picked = F.struct(F.transform("conversations", lambda m: (F.length(F.coalesce(m["content"], F.lit(""))) % 3 == 0).cast("int")).alias("is_selected"), F.transform("conversations", lambda m: F.coalesce(m["content"], F.lit(""))).alias("passage_text"))
    return _dialogues(s, d).select("pos", picked.alias("passages"), F.concat_ws(" ", "dataset", "pos").alias("query"), F.when(F.col("contextlen").isNotNull(), F.array(F.col("contextlen").cast("string"))).otherwise(_none()).alias("answers"))


def marco_v2(s, d):
    lines = F.split("text", "\n")
    picked = F.struct(F.transform(lines, lambda x: (F.length(x) % 5 == 0).cast("int")).alias("is_selected"), lines.alias("passage_text"))
    return _table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("pos"), picked.alias("passages"), F.coalesce("source", F.lit("")).alias("query"), F.when(F.col("lang").isNotNull(), F.array("lang")).otherwise(_none()).alias("answers"))


def squad(s, d):
    return _examples(s, d).select("pos", "context", "question", F.struct(F.array_compact(F.array("answer", "answer_8b")).alias("text")).alias("answers"))


def race(s, d):
    letter = F.substring(F.lit("ABCD"), F.pmod("generation_batch", F.lit(4)).cast("int") + 1, F.lit(1))
    return _table(s, d, "system_prompts").select(F.concat_ws("/", "id", "generation_batch").alias("pos"), F.col("system_prompt").alias("article"), F.col("id").alias("question"), F.array("category", "complexity", F.coalesce("domain", F.lit("-")), "id").alias("options"), letter.alias("answer"))


def race_groups(s, d):
    """Several questions for each article."""
    letter = F.substring(F.lit("ABCDE"), F.pmod("pos", F.lit(5)).cast("int") + 1, F.lit(1))
    return _examples(s, d).select("pos", F.col("context").alias("article"), "question", F.array(F.coalesce("answer", F.lit("")), F.lit("two "), F.coalesce("answer_8b", F.lit("")), F.lit("four")).alias("options"), letter.alias("answer"))


def duorc(column: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: _examples(s, d).select("pos", F.col("context").alias("plot"), "question", F.when(F.col(column).isNotNull(), F.array(column)).otherwise(_none()).alias("answers"))


def sentences(s, d):
    split = F.transform(F.split("text", "\n\n"), lambda p: F.split(p, "\n"))
    return _table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("pos"), F.struct(split.alias("sentences")).alias("context"), F.coalesce("source", F.lit("")).alias("question"), F.col("lang").alias("answer"))


def paragraphs(s, d):
    return _dialogues(s, d).select("pos", F.transform("conversations", lambda m: F.struct(m["content"].alias("paragraph_text"))).alias("paragraphs"), F.col("dataset").alias("question"), F.concat(F.lit(" item "), "pos").alias("answer"))


def pairs(s, d):
    return _dialogues(s, d).select("pos", "context", chat.pairs_of(F.col("conversations")).alias("conversations"))


def halves(s, d):
    p = pairs(s, d)
    return p.where("pos % 2 = 0"), p.where("pos % 2 = 1")


def quac(s, d):
    qas = F.transform(chat.pairs_of(F.col("conversations")), lambda p: F.struct(p["question"].alias("question"), F.struct(F.when(F.length(p["answer"]) % 4 == 0, "CANNOTANSWER").otherwise(p["answer"]).alias("text")).alias("orig_answer")))
    return _dialogues(s, d).select("pos", F.col("dataset").alias("title"), F.col("pos").cast("string").alias("background"), "context", qas.alias("qas"))


def _parallel(s, d) -> DataFrame:
    p = pairs(s, d).where("context is not null")
    answers = F.transform("conversations", lambda x: x["answer"])
    # every other row lacks its last answer
    short = F.when((F.col("pos") % 2 == 1) & (F.size(answers) > 0), F.slice(answers, F.lit(1), F.size(answers) - 1)).otherwise(answers)
    return p.select("pos", "context", F.transform("conversations", lambda x: x["question"]).alias("questions"), short.alias("answers"))


def coqa(s, d):
    return _parallel(s, d).select("pos", F.col("context").alias("story"), "questions", F.struct(F.col("answers").alias("input_text")).alias("answers"))


def newsqa(s, d):
    return _parallel(s, d).withColumnRenamed("context", "paragraph")


def drop(s, d):
    return _examples(s, d).select("pos", F.col("context").alias("passage"), "question", F.struct(F.array(F.coalesce("answer", F.lit("")), F.coalesce("answer_8b", F.lit(""))).alias("spans")).alias("answers_spans"))


def narrative(s, d):
    return _examples(s, d).select("pos", F.struct(F.struct(F.col("context").alias("text")).alias("summary")).alias("document"), F.struct(F.col("question").alias("text")).alias("question"), F.array(F.struct(F.coalesce("answer", F.lit("")).alias("text"))).alias("answers"))


def quail(s, d):
    return _examples(s, d).select("pos", "context", "question", F.array(F.coalesce("answer", F.lit("")), F.lit("not enough information"), F.coalesce("answer_8b", F.lit(""))).alias("answers"), F.pmod("pos", F.lit(3)).cast("int").alias("correct_answer_id"))


def pwc(s, d):
    return _examples(s, d).select("pos", F.col("context").alias("input"), F.col("question").alias("prompt"), F.coalesce("answer", F.lit("")).alias("answer"))


SHAPES: dict[str, Callable] = {
    "ms_marco_v1": marco_v1, "ms_marco_v2": marco_v2, "squad": squad, "race": race, "duorc_self": duorc("answer"), "duorc_paraphrase": duorc("answer_8b"), "hotpotqa": sentences, "musique": paragraphs, "2wiki": sentences,
    "ms_marco_mqa": halves, "ms_marco_v2_mqa": pairs, "quac": quac, "coqa": coqa, "drop": drop, "narrativeqa": narrative, "quail": quail, "pwc": pwc, "squad_mqa": squad, "race_mqa": race_groups, "newsqa": newsqa,
    "duorc_self_mqa": duorc("answer"), "duorc_paraphrase_mqa": duorc("answer_8b"),
}
SEEDED = {"ms_marco_v1", "ms_marco_v2", "squad", "race", "duorc_self", "2wiki", "squad_mqa", "race_mqa"}


def recipe(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s, d):
        made = SHAPES[name](s, d)
        built = recipes.build(name, *(made if isinstance(made, tuple) else (made,)), **({"seed": SEED} if name in SEEDED else {}))
        said = F.array_join(F.transform("conversations", lambda m: F.concat(m["role"], F.lit(":"), F.coalesce(m["content"], F.lit("")))), "\n")
        return built.select("dataset", F.md5("context").alias("context"), F.md5(said).alias("conversation"), "contextlen", "conversationlen")

    return run


QUERIES = {f"recipe_{name}": recipe(name) for name in recipes.RECIPES}


# --- the same in SQL ---


def _tk(x: str) -> str:
    return f"(({words(x)} * 13 + 9) // 10)"


def _emit(name: str, rows: str) -> str:
    """The query's columns of ``rows`` (ctx, turns), turns a list of structs (q, a)."""
    said = "array_to_string(list_transform(turns, lambda t: concat('user:', coalesce(t.q, ''), chr(10), 'assistant:', coalesce(concat(upper(t.a[1]), t.a[2:]), ''))), chr(10))"
    count = f"coalesce(list_sum(list_transform(turns, lambda t: {_tk('t.q')} + {_tk('t.a')})), 0) + 11 * len(turns)"
    return f"SELECT '{name}' AS dataset, md5(ctx) AS context, md5({said}) AS conversation, {_tk('ctx')}::INT AS contextlen, ({count})::INT AS conversationlen FROM ({rows})"


def _joined(rows: str, num: int, distinct: bool = False) -> str:
    """(pos, ctx, q, a) with contexts joined with those that follow in the seeded ring."""
    base = f"SELECT min(pos) AS p, ctx AS c FROM r GROUP BY ctx" if distinct else "SELECT pos AS p, ctx AS c FROM r"
    mix = "string_agg(b.c, chr(10) || chr(10) ORDER BY " + seeded("concat(a.p, '/', (b.place - a.place + a.n) % a.n)", SEED) + ")"
    on = "r.ctx = j.c" if distinct else "r.pos = j.p"
    return f"""WITH r AS ({rows}), k AS (SELECT p, c, row_number() OVER (ORDER BY {seeded('p', SEED)}) - 1 AS place, count(*) OVER () AS n FROM ({base})),
        o AS (SELECT unnest(range(0, {num})) AS off),
        j AS (SELECT a.p, any_value(a.c) AS c, {mix} AS ctx FROM k a JOIN o ON o.off < a.n JOIN k b ON b.place = (a.place + o.off) % a.n GROUP BY a.p)
        SELECT j.ctx, [{{'q': r.q, 'a': r.a}}] AS turns FROM r JOIN j ON {on}"""


def _one(rows: str) -> str:
    return f"SELECT ctx, [{{'q': q, 'a': a}}] AS turns FROM ({rows})"


def _grouped(rows: str, order: str = "pos", keep: str = "true", most: int | None = None, total: int | None = None, context: int | None = None) -> str:
    """(ctx, turns) of rows (pos, ctx, q, a) whose contexts are equal; ``keep`` says which turns stay, ``most`` trims
    from the end, ``total`` drops whole conversations."""
    run = f"sum(CASE WHEN {keep} THEN {words('q')} + {words('a')} ELSE 0 END) OVER (PARTITION BY ctx ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    g = f"SELECT *, {run} AS s FROM ({rows}) WHERE ctx IS NOT NULL"
    stay = f"({keep})" + (f" AND s <= {most}" if most else "")
    out = f"SELECT ctx, coalesce(list({{'q': q, 'a': a}} ORDER BY {order}) FILTER ({stay}), []) AS turns, max(s) AS s FROM ({g}) GROUP BY ctx"
    where = [f"{words('ctx')} <= {context}"] if context else []
    where += [f"s <= {total}"] if total else []
    return f"SELECT ctx, turns FROM ({out})" + (f" WHERE {' AND '.join(where)}" if where else "")


def _turns(context: str, q: str = "p.question", a: str = "p.answer", where: str = "true") -> str:
    kept = f"coalesce(list({{'q': {q}, 'a': {a}}} ORDER BY p.pos) FILTER (p.pos IS NOT NULL AND {where}), [])"
    return f"SELECT i.item_id, any_value({context}) AS ctx, {kept} AS turns FROM ift_data_pwc i LEFT JOIN {PAIRS} p USING (item_id) WHERE i.context IS NOT NULL AND i.conversations IS NOT NULL GROUP BY i.item_id"


def oracle_sql() -> dict[str, str]:
    ex = "split_examples WHERE question IS NOT NULL"
    q = {}
    content = "list_transform(conversations, lambda m: coalesce(m.content, ''))"
    q["ms_marco_v1"] = _joined(f"SELECT item_id AS pos, array_to_string({content}, chr(10) || chr(10)) AS ctx, concat_ws(' ', dataset, item_id) AS q, contextlen::VARCHAR AS a FROM ift_data_pwc WHERE contextlen IS NOT NULL AND conversations IS NOT NULL AND len(list_filter({content}, lambda c: length(c) % 3 = 0)) > 0", 2)
    q["ms_marco_v2"] = _joined("SELECT doc_id AS pos, array_to_string(string_split(text, chr(10)), chr(10) || chr(10)) AS ctx, coalesce(source, '') AS q, lang AS a FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND len(list_filter(string_split(text, chr(10)), lambda c: length(c) % 5 = 0)) > 0", 2)
    first = strip("coalesce(answer, answer_8b)")
    squad_rows = f"SELECT example_id AS pos, {strip('context')} AS ctx, {strip('question')} AS q, {first} AS a FROM {ex}"
    single = f"SELECT * FROM ({squad_rows}) WHERE ctx IS NOT NULL AND a IS NOT NULL"
    q["squad"] = _joined(single, 10, True)
    q["race"] = _joined(f"SELECT concat_ws('/', id, generation_batch) AS pos, {strip('system_prompt')} AS ctx, {strip('id')} AS q, {strip('[category, complexity, coalesce(domain, chr(45)), id][generation_batch % 4 + 1]')} AS a FROM system_prompts WHERE system_prompt IS NOT NULL AND generation_batch IS NOT NULL", 4, True)
    duo = lambda c: f"SELECT example_id AS pos, {strip('context')} AS ctx, {strip('question')} AS q, {strip(c)} AS a FROM {ex} AND context IS NOT NULL AND {c} IS NOT NULL"
    q["duorc_self"], q["duorc_paraphrase"] = _joined(duo("answer"), 2), _one(duo("answer_8b"))
    nested = lambda between: f"SELECT doc_id AS pos, array_to_string(list_transform(string_split(text, chr(10) || chr(10)), lambda p: array_to_string(string_split(p, chr(10)), '{between}')), chr(10) || chr(10)) AS ctx, coalesce(source, '') AS q, lang AS a FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL"
    q["hotpotqa"], q["2wiki"] = _one(nested("")), _joined(nested(" "), 2)
    q["musique"] = _one(f"SELECT array_to_string(list_filter(list_transform(conversations, lambda m: m.content), lambda c: c IS NOT NULL), chr(10) || chr(10)) AS ctx, {strip('dataset')} AS q, concat('item ', item_id) AS a FROM ift_data_pwc WHERE conversations IS NOT NULL")
    q["ms_marco_mqa"] = q["ms_marco_v2_mqa"] = f"SELECT ctx, turns FROM ({_turns('i.context')})"
    q["quac"] = f"SELECT ctx, turns FROM ({_turns('concat_ws(chr(10) || chr(10), i.dataset, i.item_id::VARCHAR, i.context)', where='coalesce(length(p.answer) % 4 != 0, true)')})"
    zipped = lambda ctx, x, y: f"SELECT ctx, list_transform(turns[:CASE WHEN item_id % 2 = 1 THEN greatest(len(turns) - 1, 0) ELSE len(turns) END], lambda t: {{'q': {x}, 'a': {y}}}) AS turns FROM ({_turns(ctx)})"
    q["coqa"], q["newsqa"] = zipped("i.context", "t.q", "t.a"), zipped("i.context", strip("t.q"), strip("t.a"))
    plain = lambda a, c="context": f"SELECT example_id AS pos, {c} AS ctx, question AS q, {a} AS a FROM {ex}"
    q["drop"] = _grouped(plain("coalesce(answer, '')"))
    q["narrativeqa"] = _grouped(plain("coalesce(answer, '')"), most=512, context=2048)
    q["quail"] = _grouped(plain("CASE example_id % 3 WHEN 0 THEN coalesce(answer, '') WHEN 1 THEN 'not enough information' ELSE coalesce(answer_8b, '') END") + " AND coalesce(CASE example_id % 3 WHEN 0 THEN answer WHEN 1 THEN 'not enough information' ELSE answer_8b END, '') != 'not enough information'", total=512, context=2048)
    q["pwc"] = _grouped(plain("coalesce(answer, '')"), keep=f"{words('q')} <= 128 AND {words('a')} <= 128", most=512, context=2048)
    shuffled = f"{seeded('pos', SEED)}, pos"
    q["squad_mqa"] = _grouped(squad_rows, shuffled)
    options = f"[coalesce(answer, ''), 'two', coalesce(answer_8b, ''), 'four', NULL][example_id % 5 + 1]"
    q["race_mqa"] = _grouped(f"SELECT example_id AS pos, {strip('context')} AS ctx, {strip('question')} AS q, {strip(options)} AS a FROM {ex}", shuffled)
    q["duorc_self_mqa"], q["duorc_paraphrase_mqa"] = _grouped(duo("answer")), _grouped(duo("answer_8b"))
    return {f"recipe_{k}": _emit(k, v) for k, v in q.items()}
