"""Built-in extractors with the schemas that model plug-ins have: keywords, triples, entity and relation mentions, embeddings.

Each takes and returns DataFrames, so a model goes in as a function of the same shape (mapInPandas, one model a worker).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions import text as fn

# Words that are no keywords and open or close no phrase.
STOP_WORDS = "a an and are as at be by for from has he in is it its of on or that the this to was were will with which we our not but they their can".split()


def tokens(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by, pos, token): lower-case words of letters and digits."""
    return df.select(*by, F.posexplode(F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")).alias("pos", "token"))


def keyword_candidates(sections: DataFrame, by: list[str], max_words: int = 250) -> DataFrame:
    """(by, keyword, score, first_pos): one- and two-word phrases without stop words, scored by the cosine of their
    count vector to that of the text."""
    t = tokens(sections.withColumn("text", fn.first_words(F.col("text"), max_words)), by)
    after = F.lead("token").over(Window.partitionBy(*by).orderBy("pos"))
    t = t.withColumn("next", after)
    good = lambda c: ~F.col(c).isin(STOP_WORDS) & (F.length(c) > 2)
    one = t.where(good("token")).select(*by, "pos", F.col("token").alias("keyword"))
    two = t.where(good("token") & F.col("next").isNotNull() & good("next")).select(*by, "pos", F.concat_ws(" ", "token", "next").alias("keyword"))
    tf = one.union(two).groupBy(*by, "keyword").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    size = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(*by)))
    return tf.select(*by, "keyword", (F.col("n") / size).alias("score"), "first_pos")


def knee(scores: Column) -> Column:
    """Of scores in descending order: how many come before the largest drop below the line from first to last."""
    n = F.size(scores)
    first, last = F.element_at(scores, 1), F.element_at(scores, -1)
    gap = F.transform(scores, lambda s, i: (first - (first - last) * i / F.greatest(n - 1, F.lit(1))) - s)
    return F.when(n < 2, n).otherwise(F.array_position(gap, F.array_max(gap)).cast("int"))


def adaptive_keywords(candidates: DataFrame, n_words: DataFrame, by: list[str], floor: float = 0.2, min_k: int = 2, max_k: int = 20, per_keyword: int = 40, max_candidates: int = 25) -> DataFrame:
    """(by, keyword, score): of each text's candidates above the floor as many as the knee says, within the bounds that
    follow from its length. n_words: (by, n_words)."""
    b = n_words.withColumn("b", fn.keyword_bounds(F.col("n_words"), min_k, max_k, per_keyword, max_candidates))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "first_pos", "keyword"))
    c = candidates.where(F.col("score") >= floor).withColumn("rank", rank).join(b, by).where("rank <= b.pool")
    window = F.transform(F.sort_array(F.collect_list(F.when((F.col("rank") >= F.col("b.lo")) & (F.col("rank") <= F.col("b.hi")), F.struct(F.col("rank").alias("r"), F.col("score").alias("s"))))), lambda x: x["s"])
    k = c.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.first("b").alias("bb"), window.alias("w"))
    k = k.withColumn("k", F.when(F.col("n") <= F.col("bb.lo"), F.col("n")).when(F.size("w") < 2, F.col("bb.lo")).otherwise(F.least(F.greatest(F.col("bb.lo") + knee(F.col("w")) - 1, F.col("bb.lo")), F.col("bb.hi"))))
    return c.join(k.select(*by, "k"), by).where("rank <= k").select(*by, "keyword", "score", "rank")


def parse_structured(responses: DataFrame, schema: str, column: str = "response") -> DataFrame:
    """Answers of a language model as rows of a schema: (…, response) -> with `parsed`, null where the answer is no such JSON."""
    return responses.withColumn("parsed", F.from_json(F.col(column), schema))


def dependency_edges(parsed: DataFrame) -> DataFrame:
    """(doc_id, source, target, dep): from each token's head to the token, lower-cased; punctuation and roots make none."""
    t = parsed.where("pos not in ('PUNCT', 'SPACE')")
    heads = t.select("doc_id", "sent_ix", F.col("i").alias("head"), F.lower("text").alias("source"))
    return t.where("dep <> 'ROOT'").join(heads, ["doc_id", "sent_ix", "head"]).select("doc_id", "source", F.lower("text").alias("target"), "dep")


def triples_from_parses(parsed: DataFrame) -> DataFrame:
    """Subject-verb-object rules over parsed tokens (doc_id, sent_ix, i, text, lemma, pos, dep, head, ent_type, chunk).

    Sentences with a verb as root only. Verbs: the root and its xcomp, ccomp and conj verbs; a verb without a subject has the
    root's. Object: dobj, else attr. From the subject to the object that is no pronoun (label: lemma), from the subject to such
    an object's prepositional nouns but `of` (lemma and preposition), and to the verb's named ones; the verb's unnamed ones only
    where it has no object and no named one. A pronoun as subject moves the anchor to the object that is none, for named
    prepositional objects only.
    """
    key = ["doc_id", "sent_ix"]
    side = lambda prefix: parsed.select(*key, *[F.col(c).alias(f"{prefix}_{c}") for c in ("i", "text", "lemma", "pos", "dep", "head", "ent_type", "chunk")])
    phrase = lambda p: fn.without_determiner(F.coalesce(F.col(f"{p}_chunk"), F.col(f"{p}_text")))
    root = side("r").where("r_dep = 'ROOT' and r_pos = 'VERB'")
    verbs = root.join(side("v"), key).where("v_i = r_i or (v_head = r_i and v_dep in ('xcomp', 'ccomp', 'conj') and v_pos = 'VERB')")
    first = lambda df, p: df.groupBy(*key, f"{p}_head").agg(F.min_by(F.struct(phrase(p).alias("text"), F.col(f"{p}_pos").alias("pos"), F.col(f"{p}_i").alias("i")), f"{p}_i").alias(p))
    subj = first(side("s").where("s_dep in ('nsubj', 'nsubjpass')"), "s")
    own = subj.select(*key, F.col("s_head").alias("v_i"), F.col("s").alias("own"))
    up = subj.select(*key, F.col("s_head").alias("r_i"), F.col("s").alias("up"))
    v = verbs.join(own, [*key, "v_i"], "left").join(up, [*key, "r_i"], "left").withColumn("subject", F.coalesce("own", "up")).where("subject is not null")
    objects = side("o").where("o_dep in ('dobj', 'attr')").groupBy(*key, F.col("o_head").alias("v_i")).agg(F.min_by(F.struct(phrase("o").alias("text"), F.col("o_pos").alias("pos"), F.col("o_i").alias("i")), F.struct(F.col("o_dep") != "dobj", "o_i")).alias("object"))
    v = v.join(objects, [*key, "v_i"], "left").select(*key, "v_i", "v_lemma", "subject", "object")
    prep = side("p").where("p_dep = 'prep'").join(side("q").where("q_dep = 'pobj'"), key).where("q_head = p_i")
    prep = prep.withColumn("nth", F.row_number().over(Window.partitionBy(*key, "p_i").orderBy("q_i"))).where("nth = 1")
    prep = prep.select(*key, F.col("p_head").alias("below"), F.lower("p_text").alias("prep"), phrase("q").alias("target"), "q_i", (F.col("q_pos") == "PRON").alias("q_pronoun"), ((F.col("q_pos") == "PROPN") | (F.coalesce("q_ent_type", F.lit("")) != "")).alias("named"))
    of_verb = v.join(prep.where("not q_pronoun").withColumnRenamed("below", "v_i"), [*key, "v_i"])
    of_object = v.where("object is not null").join(prep, key).where("below = object.i and prep <> 'of'")
    plain, pronoun = F.col("subject.pos") != "PRON", F.col("subject.pos") == "PRON"
    with_prep = F.concat_ws(" ", "v_lemma", "prep")
    any_named = of_verb.groupBy(*key, "v_i").agg(F.max("named").alias("any_named"))
    parts = [
        v.where(plain & F.col("object").isNotNull() & (F.col("object.pos") != "PRON")).select(*key, "v_i", F.lit(0).alias("at"), F.col("subject.text").alias("source"), F.col("v_lemma").alias("relation"), F.col("object.text").alias("target")),
        of_object.where(plain & (F.col("object.pos") != "PRON")).select(*key, "v_i", F.col("q_i").alias("at"), F.col("subject.text").alias("source"), with_prep.alias("relation"), "target"),
        of_verb.join(any_named, [*key, "v_i"]).where(plain & (F.col("named") | (F.col("object").isNull() & ~F.col("any_named")))).select(*key, "v_i", F.col("q_i").alias("at"), F.col("subject.text").alias("source"), with_prep.alias("relation"), "target"),
        of_verb.where(pronoun & F.col("named") & F.col("object").isNotNull() & (F.col("object.pos") != "PRON")).select(*key, "v_i", F.col("q_i").alias("at"), F.col("object.text").alias("source"), with_prep.alias("relation"), "target"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    d = out.groupBy(*key, F.lower("source").alias("s"), F.lower("relation").alias("r"), F.lower("target").alias("t")).agg(F.min_by(F.struct("source", "relation", "target"), F.struct("v_i", "at")).alias("x"), F.min(F.struct("v_i", "at")).alias("o"))
    ix = F.row_number().over(Window.partitionBy(*key).orderBy("o", "s", "r", "t")) - 1
    return d.select(*key, ix.alias("triple_ix"), "x.source", "x.relation", "x.target")


def lexicon_mentions(segments: DataFrame, labels: DataFrame, floor: float = 0.5) -> DataFrame:
    """Entity mentions (doc_id, segment_ix, pos, text, label, score): labels of a document's taxonomy found as word
    sequences. segments (doc_id, segment_ix, text); labels (doc_id, label), or for each segment its own (doc_id, segment_ix,
    label). The score is a fixed formula of the length."""
    by = [c for c in ("doc_id", "segment_ix") if c in labels.columns]
    t = tokens(segments, ["doc_id", "segment_ix"])
    lab = labels.where(F.col("label") != "").withColumn("words", F.split(F.lower("label"), "[_ ]+")).withColumn("n", F.size("words"))
    lens = sorted(r[0] for r in lab.select("n").distinct().collect())  # lengths of labels: a few numbers
    out = None
    for n in lens or [1]:
        w = Window.partitionBy("doc_id", "segment_ix").orderBy("pos")
        gram = t.select("doc_id", "segment_ix", "pos", F.concat_ws(" ", "token", *[F.lead("token", k).over(w) for k in range(1, n)]).alias("text"))
        hit = gram.join(lab.where(F.col("n") == n).select(*by, "label", F.array_join("words", " ").alias("text")).distinct(), [*by, "text"])
        hit = hit.select("doc_id", "segment_ix", "pos", "text", "label", F.lit(round(1 - 0.5 / (n + 1), 6)).alias("score"))
        out = hit if out is None else out.union(hit)
    return out.where(F.col("score") >= floor)


def adjacent_in_row(rows: DataFrame, words: str, kind: Column, score: Column) -> DataFrame:
    """Relations between each word and the next of an array of words, made inside the row without a shuffle. rows: (doc_id,
    doc_ord, segment_ix, words); kind and score may use text and next_text."""
    pairs = F.transform(F.slice(F.col(words), 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda x, i: F.struct(i.alias("pos"), x.alias("text"), F.get(F.col(words), i + 1).alias("next_text")))
    p = rows.select("doc_id", "doc_ord", "segment_ix", F.explode(pairs).alias("p")).select("doc_id", "doc_ord", "segment_ix", "p.*")
    return p.select("doc_id", "doc_ord", "segment_ix", "pos", F.col("text").alias("head_text"), kind.alias("relation_type"), F.col("next_text").alias("tail_text"), score.alias("score"))


def adjacent_relations(mentions: DataFrame, kind: Column, score: Column) -> DataFrame:
    """Relations between each mention and the next of its segment. kind and score may use text, label, next_text, next_label."""
    w = Window.partitionBy("doc_id", "segment_ix").orderBy("pos")
    m = mentions.withColumns({"next_text": F.lead("text").over(w), "next_label": F.lead("label").over(w)}).where("next_text is not null")
    keep = [c for c in ("doc_id", "doc_ord", "segment_ix", "pos") if c in m.columns]
    return m.select(*keep, F.col("text").alias("head_text"), kind.alias("relation_type"), F.col("next_text").alias("tail_text"), score.alias("score"))


def hashed_vectors(df: DataFrame, by: list[str], text: str = "text", size: int = 64) -> DataFrame:
    """(by, vector): counts of words hashed to `size` places, of length one. Texts without words have no row."""
    slot = F.pmod(F.conv(F.substring(F.md5("token"), 1, 7), 16, 10).cast("long"), F.lit(size)).cast("int")
    c = tokens(df, by, text).groupBy(*by, slot.alias("slot")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    c = c.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return c.select(*by, raw.alias("raw")).select(*by, F.transform("raw", lambda x: x / fn.norm(F.col("raw"))).alias("vector"))
