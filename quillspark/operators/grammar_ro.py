"""Romanian grammar rules over tokens of a sentence; lists are fixed values of the language's school grammar.

Agreement rules need an annotator's tags and heads; they work on a table of tokens with tag and head_ix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .segment import SENT

#: Neighbouring words that sound badly together.
CACOPHONIES = [("la", "la"), ("sa", "sa"), ("ca", "ca"), ("ca", "că"), ("ca", "ce"), ("ca", "ci"), ("că", "ca"), ("cu", "co"), ("că", "cu"), ("că", "când"), ("ca", "când"), ("că", "câ")]
#: Wrong forms of the verb "a voi".
WRONG_FORMS = ["vroiam", "vroiai", "vroia", "vroiau", "vroiaţi"]
#: Adverbs that don't begin a sentence.
START_ADVERBS = ["totuși", "așadar", "deci"]


def cacophonies(tokens: DataFrame, pairs: list[tuple[str, str]] = CACOPHONIES) -> DataFrame:
    """Positions of the first word of each listed pair of neighbours."""
    w = Window.partitionBy(*SENT).orderBy("tok_ix")
    rows = tokens.withColumn("next", F.lead("lemma").over(w))
    hit = F.lit(False)
    for a, b in pairs:
        hit = hit | ((F.col("lemma") == a) & (F.col("next") == b))
    return rows.filter(hit).select(*SENT, "tok_ix", "lemma", "next")


def near_repetitions(tokens: DataFrame, window: int = 8) -> DataFrame:
    """Positions of a lemma that the last window - 1 tokens of the sentence have already; stop words and punctuation don't count.

    The last place of the same lemma is enough to know, so one window function over (sentence, lemma) does it; where documents are dealt by id it shuffles nothing.
    """
    w = Window.partitionBy(*SENT, "lemma").orderBy("tok_ix")
    rows = tokens.filter(~F.col("is_stop") & F.col("text").rlike(r"\p{L}"))
    return rows.withColumn("before", F.lag("tok_ix").over(w)).filter(F.col("tok_ix") - F.col("before") < window).select(*SENT, "tok_ix", "lemma", "before")


def without_comma(tokens: DataFrame, word: str = "totuși") -> DataFrame:
    """Positions of a word that no comma stands before; at the start of a sentence none is needed."""
    w = Window.partitionBy(*SENT).orderBy("tok_ix")
    return tokens.withColumn("before", F.lag("text").over(w)).filter((F.col("lemma") == word) & F.col("before").isNotNull() & (F.col("before") != ",")).select(*SENT, "tok_ix", "before")


def sentences_without_comma(sentences: DataFrame, word: str = "totuși") -> DataFrame:
    """The same, found in the array of each sentence's words; at the start of a sentence none is needed."""
    before = lambda i: F.get("words", i - 1)
    at = F.transform("words", lambda x, i: F.struct(i.alias("tok_ix"), before(i).alias("before"), (F.lower(x) == word).alias("hit")))
    return sentences.select(*SENT, F.inline(F.filter(at, lambda x: x["hit"] & x["before"].isNotNull() & (x["before"] != ",")))).select(*SENT, "tok_ix", "before")


def listed(tokens: DataFrame, words: list[str], first: bool = False) -> DataFrame:
    """Positions of listed words, only at the start of a sentence if first."""
    out = tokens.filter(F.col("lemma").isin(*words))
    return (out.filter("tok_ix = 0") if first else out).select(*SENT, "tok_ix", "lemma")


def misspelled(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """lemma, n of words with letters that the dictionary(word) lacks."""
    words = tokens.filter(F.col("text").rlike(r"\p{L}")).groupBy("lemma").agg(F.count(F.lit(1)).alias("n"))
    return words.join(dictionary.select(F.col("word").alias("lemma")), "lemma", "left_anti")


def suggestions(words: DataFrame, dictionary: DataFrame, most: int = 2, top: int = 3) -> DataFrame:
    """lemma, rank, word: dictionary words up to most edits away, nearest first, that share a deletion variant with the word.

    Words within d edits share a string that deleting up to d letters from each gives; the join is on these, not on all pairs.
    """

    def variants(c: Column) -> Column:
        one = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
        out = F.array_union(F.array(c), one(c))
        return F.array_distinct(F.concat(out, F.flatten(F.transform(one(c), one)))) if most > 1 else out

    a = words.select("lemma", F.explode(variants(F.col("lemma"))).alias("v"))
    b = dictionary.select("word", F.explode(variants(F.col("word"))).alias("v"))
    near = a.join(b, "v").select("lemma", "word").distinct().withColumn("d", F.levenshtein("lemma", "word")).filter(F.col("d") <= most)
    w = Window.partitionBy("lemma").orderBy("d", "word")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("lemma", "rank", "word")


def disagreements(tokens: DataFrame, gender_slot: int = 3, number_slot: int = 4) -> DataFrame:
    """Adjectives, numerals and articles whose gender or number differs from their noun's, by slots of the tags (from 0).

    tokens with tag and head_ix; a slot with - or beyond the tag's end tells nothing and agrees with all.
    """
    slot = lambda tag, k: F.nullif(F.nullif(F.substring(tag, k + 1, 1), F.lit("")), F.lit("-"))
    heads = tokens.select(*SENT, F.col("tok_ix").alias("head_ix"), F.col("tag").alias("head_tag"), F.col("text").alias("head"))
    rows = tokens.join(heads, [*SENT, "head_ix"]).filter(F.col("tag").rlike("^[AMT]") & F.col("head_tag").rlike("^N"))
    g = slot(F.col("tag"), gender_slot) != slot(F.col("head_tag"), 2)
    n = slot(F.col("tag"), number_slot) != slot(F.col("head_tag"), 3)
    return rows.withColumn("gender", F.coalesce(g, F.lit(False))).withColumn("number", F.coalesce(n, F.lit(False))).filter("gender or number").select(*SENT, "tok_ix", "text", "head", "gender", "number")


def comparatives(text: Column) -> Column:
    """Comparisons written with de or ca behind the comparative."""
    return F.regexp_extract_all(text, F.lit(r"(?i)mai\s[\p{L}\p{N}]+\s(?:de|ca)"), F.lit(0))


def collapsed_spaces(text: Column) -> Column:
    """Runs of spaces as one, none before punctuation."""
    return F.regexp_replace(F.regexp_replace(text, " {2,}", " "), r" +([,.;:!?])", "$1")


def with_offsets(tokens: DataFrame) -> DataFrame:
    """tokens with start and end: character offsets in the sentence written with single spaces between tokens."""
    w = Window.partitionBy(*SENT).orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("int")).withColumn("end", F.col("start") + F.length("text"))


#: Values that each morphological feature may have (fixed values of the universal tag set).
FEATURES = {"Case": ["Acc", "Nom", "Dat", "Gen", "Voc"], "Definite": ["Def", "Ind"], "Degree": ["Cmp", "Pos", "Sup"], "Gender": ["Fem", "Masc"], "Mood": ["Imp", "Ind", "Sub"], "Number": ["Plur", "Sing"], "Person": ["1", "2", "3"], "Polarity": ["Neg", "Pos"], "PronType": ["Art", "Dem", "Emp", "Ind", "Int", "Rel", "Neg", "Prs", "Tot"], "Tense": ["Fut", "Imp", "Past", "Pqp", "Pres"], "VerbForm": ["Fin", "Ger", "Inf", "Part"], "NumForm": ["Digit", "Roman", "Word"], "NumType": ["Card", "Ord"], "Poss": ["Yes"], "Reflex": ["Yes"], "Strength": ["Strong", "Weak"], "Abbr": ["Yes"], "Foreign": ["Yes"], "Position": ["Postnom", "Prenom"], "PartType": ["Inf"], "AdpType": ["Prep"], "Number[psor]": ["Plur", "Sing"], "Variant": ["Short"]}


def feature_values(feats: Column, name: str) -> Column:
    """The known values of a feature in a string such as Case=Acc,Nom|Number=Sing."""
    found = F.split(F.regexp_extract(feats, r"(?:^|\|)" + name.replace("[", r"\[").replace("]", r"\]") + r"=([A-Za-z0-9,]*)", 1), ",")
    return F.filter(found, lambda x: x.isin(*FEATURES[name]))


# --- agreement of subject and predicate, corrections ---


def predicate_disagreements(tokens: DataFrame) -> DataFrame:
    """Subjects whose person or number differs from their predicate's, by slots of the tags: verbs have person and number at 4 and 5 (from 0), nouns number at 3, pronouns person and number at 2 and 4.

    tokens with tag, head_ix and dep. A noun is third person. Several subjects of one predicate, or one with a coordinated word below it, are plural.
    A predicate that is no verb (a predicative name) is compared by the verb that hangs from it as copula.
    """
    slot = lambda tag, k: F.nullif(F.nullif(F.substring(tag, k + 1, 1), F.lit("")), F.lit("-"))
    key = [*SENT, "head_ix"]
    verbs = tokens.filter(F.col("tag").startswith("V"))
    own = verbs.select(*SENT, F.col("tok_ix").alias("head_ix"), F.col("tag").alias("verb_tag"), F.col("text").alias("verb"))
    copula = verbs.filter("dep = 'cop'").groupBy(*key).agg(F.min_by("tag", "tok_ix").alias("cop_tag"), F.min_by("text", "tok_ix").alias("cop"))
    joined = tokens.filter("dep = 'conj'").select(*SENT, F.col("head_ix").alias("tok_ix")).distinct().withColumn("several", F.lit(True))
    subjects = tokens.filter(F.col("dep").isin("nsubj", "nsubj:pass") & F.col("tag").rlike("^[NP]")).join(joined, [*SENT, "tok_ix"], "left")
    many = subjects.groupBy(*key).agg(F.count(F.lit(1)).alias("subjects"))
    rows = subjects.join(own, key, "left").join(copula, key, "left").join(many, key)
    tag, noun = F.coalesce("verb_tag", "cop_tag"), F.col("tag").startswith("N")
    plural = F.coalesce(F.col("several"), F.lit(False)) | (F.col("subjects") > 1)
    person = F.when(noun, "3").otherwise(slot(F.col("tag"), 2))
    number = F.when(plural, "p").when(noun, slot(F.col("tag"), 3)).otherwise(slot(F.col("tag"), 4))
    wrong = lambda a, b: F.coalesce(a != b, F.lit(False))
    rows = rows.withColumns({"predicate": F.coalesce("verb", "cop"), "person": wrong(person, slot(tag, 4)) & ~plural, "number": wrong(number, slot(tag, 5))})
    return rows.filter("predicate is not null and (person or number)").select(*SENT, "tok_ix", "text", "predicate", "person", "number")


def synonym_repetitions(tokens: DataFrame, synonyms: DataFrame, window: int = 8) -> DataFrame:
    """Positions of a lemma of which a synonym(word, synonym) is among the window - 1 tokens before it in the sentence.

    Tokens meet on (sentence, synonym), so only pairs that the lexicon has are formed.
    """
    t = tokens.select(*SENT, "tok_ix", "lemma")
    wanted = t.join(synonyms.select(F.col("word").alias("lemma"), "synonym"), "lemma")
    met = wanted.join(t.select(*SENT, F.col("tok_ix").alias("before"), F.col("lemma").alias("synonym")), [*SENT, "synonym"])
    return met.filter((F.col("before") < F.col("tok_ix")) & (F.col("tok_ix") - F.col("before") < window)).select(*SENT, "tok_ix", "lemma", "before", "synonym")


#: Conjunctions that join what is alike, and those that oppose (fixed values).
COORDINATING, ADVERSATIVE = ["și", "sau", "ori", "fie"], ["dar", "iar", "însă", "ci"]


#: What ends a word, and what begins one: no letter or digit, which is consumed, as other engines can't look around.
_END, _START = r"([^\p{L}\p{N}]|$)", r"(^|[^\p{L}\p{N}])"


def commas_at_coordination(text: Column, words: list[str] = COORDINATING) -> Column:
    """Coordinating conjunctions with a comma before them, then those with one behind them, as written."""
    any_of = "(?:" + "|".join(words) + ")"
    return F.concat(F.regexp_extract_all(text, F.lit(rf"(?i),\s*{any_of}{_END}"), F.lit(0)), F.regexp_extract_all(text, F.lit(rf"(?i){_START}{any_of}\s*,"), F.lit(0)))


def missing_adversative_commas(text: Column, words: list[str] = ADVERSATIVE) -> Column:
    """Adversative conjunctions that no comma stands before, with the letter before them."""
    return F.regexp_extract_all(text, F.lit(r"(?i)[\p{L}\p{N}]\s+(?:" + "|".join(words) + ")" + _END), F.lit(0))


def corrections(adversative: list[str] = ADVERSATIVE, coordinating: list[str] = COORDINATING) -> list[tuple[str, str]]:
    """Patterns and what takes their place, in order: commas at conjunctions, comparatives with decât, forms of "a voi", runs of spaces."""
    return [
        (r"(?i),\s*(" + "|".join(coordinating) + r")(?:\s*,)?([^\p{L}\p{N},]|$)", " $1$2"),
        (r"(?i)([\p{L}\p{N}])\s+(" + "|".join(adversative) + ")" + _END, "$1, $2$3"),
        (r"(?i)(mai\s[\p{L}\p{N}]+\s)(?:de|ca)" + _END, "$1decât$2"),
        (_START + "vroi(am|ai|a|au|aţi)" + _END, "$1voi$2$3"),
        (" {2,}", " "),
        (" +([,.;:!?])", "$1"),
    ]


def corrected(text: Column, adversative: list[str] = ADVERSATIVE, coordinating: list[str] = COORDINATING) -> Column:
    """A text with what rules can mend."""
    for pattern, new in corrections(adversative, coordinating):
        text = F.regexp_replace(text, pattern, new)
    return text


# --- subject and predicate ---


def _slot(tag: Column, k: int) -> Column:
    """A slot of a tag (from 0); null where it is - or beyond the end."""
    return F.nullif(F.nullif(F.substring(tag, k + 1, 1), F.lit("")), F.lit("-"))


def _features(tag: Column) -> tuple[Column, Column, Column]:
    """Person, number and gender by the first letter of a tag: nouns are third persons; what a tag doesn't tell is null."""
    first = F.substring(tag, 1, 1)
    person = F.when(first == "N", F.lit("3")).when(first == "P", _slot(tag, 2)).when(first == "V", _slot(tag, 4))
    number = F.when(first.isin("N", "M"), _slot(tag, 3)).when(first.isin("P", "A"), _slot(tag, 4)).when(first == "V", _slot(tag, 5))
    gender = F.when(first.isin("N", "M"), _slot(tag, 2)).when(first.isin("P", "A"), _slot(tag, 3))
    return person, number, gender


def subject_disagreements(tokens: DataFrame, collective: DataFrame, jobs: DataFrame) -> DataFrame:
    """SENT, tok_ix (first subject), kind, at, person, number, gender: verbs, copulas and predicative names that don't agree with their subject.

    tokens: SENT, tok_ix, lemma, tag, dep, head_ix (a table of an annotator). A predicate's subjects are its nsubj nouns and pronouns and those
    coordinated with them; several are plural, of the lowest person among them, and feminine only if all are. Predicates coordinated with one that has a subject
    share it unless they have their own. kind tells what is compared: verb (a finite verb, or the auxiliary of a participle), copula (cop, or the auxiliary of one that
    isn't finite), name (predicative adjective, noun or numeral; number and gender). What a tag leaves open agrees with all. Singular subjects of collective(word) may have a plural verb,
    and predicative nouns of jobs(word) any gender.
    """
    t = tokens.select(*SENT, "tok_ix", F.lower("lemma").alias("lemma"), "tag", "dep", "head_ix")
    nominal = t.filter(F.col("tag").rlike("^[NP]"))
    own = nominal.filter(F.col("dep").rlike("^nsubj") & (F.col("head_ix") != F.col("tok_ix"))).select(*SENT, "tok_ix", "lemma", "tag", F.col("head_ix").alias("predicate"))
    joined = nominal.filter("dep = 'conj'").join(own.select(*SENT, F.col("tok_ix").alias("head_ix"), "predicate"), [*SENT, "head_ix"])
    person, number, gender = _features(F.col("tag"))
    parts = own.unionByName(joined.select(*SENT, "tok_ix", "lemma", "tag", "predicate")).select(*SENT, "predicate", "tok_ix", "lemma", person.alias("p"), number.alias("n"), gender.alias("g"))
    first = F.min(F.struct("tok_ix", "lemma")).alias("first")
    subject = parts.groupBy(*SENT, "predicate").agg(first, F.count(F.lit(1)).alias("k"), F.min("p").alias("p"), F.min("n").alias("n"), F.max(F.when(F.col("g") != "f", "m").otherwise(F.col("g"))).alias("g"))
    subject = subject.join(collective.select(F.lower("word").alias("__word"), F.lit(True).alias("collective")).distinct(), F.col("first.lemma") == F.col("__word"), "left")
    subject = subject.select(*SENT, F.col("predicate").alias("tok_ix"), F.col("first.tok_ix").alias("s_ix"), F.col("p").alias("sp"), F.when(F.col("k") > 1, "p").otherwise(F.col("n")).alias("sn"), F.col("g").alias("sg"), (F.coalesce("collective", F.lit(False)) & (F.col("k") == 1)).alias("sc"))
    # predicates coordinated with one that has a subject
    also = t.filter("dep = 'conj'").select(*SENT, F.col("tok_ix").alias("q"), F.col("head_ix").alias("tok_ix")).join(subject, [*SENT, "tok_ix"]).drop("tok_ix").withColumnRenamed("q", "tok_ix")
    every = subject.unionByName(also.join(subject.select(*SENT, "tok_ix"), [*SENT, "tok_ix"], "left_anti").select(*subject.columns))
    verbal, finite = F.col("tag").rlike("^V"), _slot(F.col("tag"), 4).isNotNull() | F.col("tag").rlike("^V[ma]i")
    predicates = every.join(t.select(*SENT, "tok_ix", "lemma", "tag"), [*SENT, "tok_ix"]).withColumn("verbal", verbal)
    of = predicates.drop("lemma", "tag").withColumnRenamed("tok_ix", "head_ix").join(t.select(*SENT, "tok_ix", "tag", "dep", "head_ix"), [*SENT, "head_ix"])
    cop = of.filter((~F.col("verbal")) & (F.col("dep") == "cop"))
    bare = cop.filter(~finite).select(*SENT, "head_ix").distinct()
    aux = of.filter((F.col("dep") == "aux") & F.col("tag").rlike("^Va") & finite)
    participles = predicates.filter(F.col("verbal") & ~finite).select(*SENT, F.col("tok_ix").alias("head_ix"))
    columns = [*SENT, "s_ix", "sp", "sn", "sg", "sc", "tok_ix", "tag"]
    verbs = predicates.filter(F.col("verbal") & finite).select(*columns, F.lit("verb").alias("kind"))
    verbs = verbs.unionByName(aux.join(participles, [*SENT, "head_ix"], "left_semi").select(*columns, F.lit("verb").alias("kind")))
    verbs = verbs.unionByName(cop.filter(finite).select(*columns, F.lit("copula").alias("kind")))
    verbs = verbs.unionByName(aux.join(bare, [*SENT, "head_ix"], "left_semi").select(*columns, F.lit("copula").alias("kind")))
    p, n, g = _features(F.col("tag"))
    no = F.lit(False)
    differs = lambda a, b: F.coalesce(a != b, no)
    verbs = verbs.select(*SENT, F.col("s_ix").alias("tok_ix"), "kind", F.col("tok_ix").alias("at"), differs(F.col("sp"), p).alias("person"), (differs(F.col("sn"), n) & ~(F.col("sc") & (n == "p"))).alias("number"), no.alias("gender"))
    names = predicates.filter(F.col("tag").rlike("^(Af|Nc|M[oc])")).join(jobs.select(F.lower("word").alias("lemma"), F.lit(True).alias("job")).distinct(), "lemma", "left")
    names = names.select(*SENT, F.col("s_ix").alias("tok_ix"), F.lit("name").alias("kind"), F.col("tok_ix").alias("at"), no.alias("person"), differs(F.col("sn"), n).alias("number"), (differs(F.col("sg"), g) & ~F.coalesce("job", no)).alias("gender"))
    return verbs.unionByName(names).filter("person or number or gender")
