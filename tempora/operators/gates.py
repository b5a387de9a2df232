"""Gates of provisions and the three tests that class a unit, with the evidence kept beside the verdict.

A gate is a clause that says when, or to whom, other provisions apply. Its references are parted at exclusion words into
targets and exclusions, and made keys where they say enough; a reference that doesn't is dropped and the gate is no longer
derivable, rather than widened. A unit is a gate, or a norm for an actor, or a premise, by a cascade that keeps its path and
warns where the title and the markers disagree.

Everything is a column expression over the unit's text, title and key: no Python runs on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.text import MARKERS

_EDGE, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_AND = r"\s*(?:,|;|và|hoặc)\s*"
_POINT, _NUMBER = r"[a-zđ](?![\p{L}\p{N}_)])", rf"\d+[a-zđ]?{_END}"


def _list_of(word: str, item: str) -> str:
    return rf"{word}\s+(?:{item}(?:(?:{_AND}|\s+đến\s+)(?:{word}\s+)?{item})*|này{_END})"


#: A reference, from the innermost unit outwards; the number of another document may follow its kind.
REFERENCE = (
    rf"(?iu){_EDGE}(?=(?:điểm|khoản|điều)\s)({_list_of('điểm', _POINT)})?\s*({_list_of('khoản', _NUMBER)})?\s*({_list_of('điều', _NUMBER)})?"
    r"(?:\s+(?:của\s+)?(?:thông tư|nghị định|luật|bộ luật|quyết định|nghị quyết|văn bản hợp nhất)\s+(?:số\s+)?(\d+\w*/[\w/\p{L}-]*[\w\p{L}]))?"
)


def _items(said: Column, word: str, item: str) -> Column:
    """The members of a list, a range of numbers written out."""
    parts = F.split(F.regexp_replace(said, rf"(?iu){_EDGE}{word}\s+", ""), f"(?iu){_AND}")
    low, high = (lambda p: F.regexp_extract(p, r"(?iu)^(\d+)\s+đến\s+(\d+)$", 1).try_cast("int")), (lambda p: F.regexp_extract(p, r"(?iu)^(\d+)\s+đến\s+(\d+)$", 2).try_cast("int"))
    one = lambda p: F.filter(F.split(F.trim(p), r"(?iu)\s+đến\s+"), lambda x: x.rlike(f"(?iu)^{item}$"))
    many = lambda p: F.when(low(p) <= high(p), F.transform(F.sequence(low(p), high(p)), lambda n: n.cast("string"))).otherwise(one(p))
    return F.array_distinct(F.flatten(F.transform(parts, many)))


def references(text: Column) -> Column:
    """The references in a text, in order: (raw, points, clauses, articles, this_clause, this_article, number).

    points, clauses and articles are arrays; this_*: said as 'this clause' or 'this article'; number: of the document that is
    named, or null. A document's number alone is no reference.
    """
    part = lambda raw, n: F.regexp_extract(raw, REFERENCE, n)
    this = lambda said: said.rlike(rf"(?iu)này$")  # noqa: E731, F541
    whole = F.filter(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), lambda raw: (F.trim(raw) != "") & ((part(raw, 1) != "") | (part(raw, 2) != "") | (part(raw, 3) != "")))
    return F.transform(
        whole,
        lambda raw: F.struct(
            F.trim(raw).alias("raw"), _items(part(raw, 1), "điểm", "[a-zđ]").alias("points"), _items(part(raw, 2), "khoản", r"\d+[a-zđ]?").alias("clauses"), _items(part(raw, 3), "điều", r"\d+[a-zđ]?").alias("articles"),
            this(part(raw, 2)).alias("this_clause"), this(part(raw, 3)).alias("this_article"), F.nullif(part(raw, 4), F.lit("")).alias("number"),
        ),
    )


def _vague(r: Column) -> Column:
    """Whether a reference doesn't name one place: a clause without its article, or one clause of several articles."""
    inner = (F.size(r["clauses"]) > 0) | (F.size(r["points"]) > 0)
    return inner & (((F.size(r["articles"]) == 0) & ~r["this_article"]) | (F.size(r["articles"]) > 1))


def _or_none(names: Column) -> Column:
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(None).cast("string")))


def keys_of(r: Column, number: Column, article: Column, clause: Column) -> Column:
    """The node keys that a reference names, seen from a document's number, article and clause; none where that isn't enough."""
    none = F.slice(F.array(F.lit("")), 1, 0)
    articles = F.when(F.size(r["articles"]) > 0, r["articles"]).when(r["number"].isNull() & article.isNotNull(), F.array(article)).otherwise(none)
    clauses = F.when(F.size(r["clauses"]) > 0, r["clauses"]).when(r["this_clause"] & clause.isNotNull(), F.array(clause)).when((F.size(r["points"]) > 0) & (F.size(r["articles"]) == 0) & clause.isNotNull(), F.array(clause)).otherwise(none)
    short = (r["this_clause"] & clause.isNull()) | ((F.size(r["points"]) > 0) & (F.size(clauses) == 0)) | F.coalesce(r["number"], number).isNull()
    base = F.concat(F.coalesce(r["number"], number), F.lit("#than/dieu_"))
    name = lambda a, c, p: F.concat(base, a, F.coalesce(F.concat(F.lit("#khoan_"), c), F.lit("")), F.coalesce(F.concat(F.lit("#diem_"), p), F.lit("")))
    every = F.flatten(F.transform(articles, lambda a: F.flatten(F.transform(_or_none(clauses), lambda c: F.transform(_or_none(r["points"]), lambda p: name(a, c, p))))))
    return F.when(short, none).otherwise(every)


#: Clauses of effect, of replacement, of application, and what begins an exclusion.
EFFECT = r"(?iu)(có|hết)\s+hiệu\s+lực(?:\s+thi\s+hành)?\s*(đến\s+hết|kể\s+từ|từ|vào)?\s*ngày(?:\s*(\d{1,2})\s*tháng\s*(\d{1,2})\s*năm\s*(\d{4}))?"
REPLACES = r"(?iu)(?:thay\s+thế\s+cho|bãi\s+bỏ)\s+(?:Nghị\s+định|Thông\s+tư|Quyết\s+định|Điều)"
EXCEPT = r"(?iu)trừ\s+(?:trường\s+hợp|quy\s+định|các\s+quy\s+định)"
APPLIES = r"(?iu)((?:Quy\s+định\s+tại\s+)?[^.;:]{0,60}?(Nghị\s+định|Thông\s+tư|Quyết\s+định|Chương|Mục|Điều|Khoản)\s+này)([^.;:]{0,40}?)\s*áp\s+dụng\s+(?:đối\s+với|cho)"
#: Scopes by their word; those that have nodes of their own.
SCOPES = {"chương": "chapter", "mục": "section", "điều": "article", "khoản": "clause"}
WITH_NODES = ("document", "article", "clause")


def _before(text: Column, pattern: str) -> Column:
    """What stands before the first match; all of it without one."""
    return F.split(text, pattern, 2)[0]


def _after(text: Column, pattern: str) -> Column:
    """What stands after the first match, or an empty string."""
    return F.coalesce(F.get(F.split(text, pattern, 2), F.lit(1)), F.lit(""))


def evidence(text: Column) -> dict[str, Column]:
    """The references that a gate is read from: before a clause of effect, after an exclusion, before a clause of application."""
    none = F.slice(references(F.lit("")), 1, 0)
    read = lambda pattern, where: F.when(text.rlike(pattern), references(where)).otherwise(none)
    effect = text.rlike(EFFECT)
    return {
        "said": read(EFFECT, _before(text, EFFECT)),
        "left_out": F.when(effect & text.rlike(EXCEPT), references(_after(text, EXCEPT))).otherwise(none),
        "head": F.when(effect, none).otherwise(read(APPLIES, F.regexp_extract(text, APPLIES, 1))),
    }


def gate(text: Column, key: Column, refs: dict[str, Column] | None = None) -> Column:
    """(kind, scope, targets, exclusions, derivable, negative, note) of the gate that a unit's text states, or null.

    kind: 'time' or 'subject'. targets and exclusions are node keys; without targets a scope stands for itself. derivable:
    whether all that the clause names became keys, or it names nothing. note: 'foreign' where another document's provisions
    are named, 'unresolved' where references gave no key, 'replaces' where other documents end, 'no_node' for chapters and
    sections, 'partly' where some references were dropped. refs: the evidence, where it is in columns already.
    """
    refs = refs or evidence(text)
    number, article = F.nullif(F.regexp_extract(key, "^([^#]+)", 1), F.lit("")), F.nullif(F.regexp_extract(key, "dieu_([^#]+)", 1), F.lit(""))
    clause = F.nullif(F.regexp_extract(key, "khoan_([^#]+)", 1), F.lit(""))
    foreign = lambda refs: F.exists(refs, lambda r: r["number"].isNotNull() & F.coalesce(r["number"] != number, F.lit(True)))
    own = lambda refs: F.filter(refs, lambda r: r["number"].isNull() | F.coalesce(r["number"] == number, F.lit(False)))
    keys = lambda refs: F.array_distinct(F.flatten(F.transform(F.filter(refs, lambda r: ~_vague(r)), lambda r: keys_of(r, number, article, clause))))
    vague = lambda refs: F.exists(refs, _vague)
    none = F.slice(F.array(F.lit("")), 1, 0)
    fine = lambda refs: F.when(F.forall(refs, lambda r: (F.size(r["clauses"]) > 0) | r["this_clause"]), "clause").otherwise("article")

    def made(kind: str, scope, targets, exclusions, derivable, negative, note) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(kind).alias("kind"), lit(scope).alias("scope"), targets.alias("targets"), exclusions.alias("exclusions"), lit(derivable).alias("derivable"), lit(negative).alias("negative"), lit(note).alias("note"))

    said = refs["said"]
    inner, left_out = own(said), own(refs["left_out"])
    targets, exclusions = keys(inner), keys(left_out)
    dropped = vague(inner) | vague(left_out)
    time = (
        F.when(foreign(said), made("time", "document", none, none, False, False, "foreign"))
        .when(F.size(targets) > 0, made("time", fine(inner), targets, exclusions, ~dropped, False, F.when(dropped, "partly").otherwise("")))
        .when(F.size(inner) > 0, made("time", "document", none, exclusions, False, False, "unresolved"))
        .otherwise(made("time", "document", none, exclusions, True, False, F.when(vague(left_out), "partly").otherwise("")))
    )
    replaces = made("time", "document", none, none, False, False, "replaces")

    part = lambda n: F.regexp_extract(text, APPLIES, n)
    head = refs["head"]
    named = F.when(foreign(head), none).otherwise(keys(own(head)))
    negative = part(3).rlike(rf"(?iu){_EDGE}không{_END}")
    word = F.lower(F.regexp_replace(part(2), r"(?U)\s+", " "))
    scope = F.lit("document")
    for name, kind in SCOPES.items():
        scope = F.when(word == name, kind).otherwise(scope)
    here = F.concat(number, F.lit("#than/dieu_"), article)
    self_ = F.when((scope == "article") & here.isNotNull(), F.array(here)).when((scope == "clause") & here.isNotNull() & clause.isNotNull(), F.array(F.concat(here, F.lit("#khoan_"), clause))).otherwise(none)
    has_node = scope.isin(*WITH_NODES)
    subject = F.when(F.size(named) > 0, made("subject", fine(own(head)), named, none, ~vague(own(head)), negative, F.when(vague(own(head)), "partly").otherwise(""))).otherwise(
        made("subject", scope, self_, none, has_node, negative, F.when(has_node, "").otherwise("no_node"))
    )
    return F.when(text.rlike(EFFECT), time).when(text.rlike(REPLACES), replaces).when(part(1) != "", subject)


#: Classes of articles by their titles, tried in order: (pattern, class, kind of premise).
TITLES = (
    (r"(?iu)trách nhiệm (thi hành|tổ chức thực hiện)", "actor_cu", None),
    (r"(?iu)phạm vi điều chỉnh", "premise", "pham_vi"),
    (r"(?iu)giải thích (từ ngữ|thuật ngữ)", "premise", "dinh_nghia"),
    (r"(?iu)nguyên tắc chung", "premise", "pham_vi"),
    (r"(?iu)đối tượng áp dụng", "meta_cu", None),
    (r"(?iu)hiệu lực (thi hành|của)", "meta_cu", None),
    (r"(?iu)(điều khoản|quy định) chuyển tiếp", "meta_cu", None),
)
#: Uses of 'phải' that put no duty on anybody.
TRAPS = (r"(?iu)không\s+phải\s+là", rf"(?iu){_EDGE}(?:tiền|khoản|chênh\s+lệch|công\s+nợ|số){_END}[^.;]{{0,25}}?phải\s+(?:thu|trả|nộp)(?:\s*,\s*phải\s+(?:thu|trả|nộp))*")


def title_class(title: Column) -> tuple[Column, Column]:
    """(class, kind of premise) that an article's title says, both null where it says nothing."""
    name, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, cls, premise in reversed(TITLES):
        hit = title.rlike(pattern)
        name, kind = F.when(hit, cls).otherwise(name), F.when(hit, F.lit(premise).cast("string")).otherwise(kind)
    return name, kind


def duties(text: Column) -> Column:
    """Whether a text has markers of duty or prohibition once the traps are blanked."""
    for trap in TRAPS:
        text = F.regexp_replace(text, trap, " ")
    words = "|".join(sorted((w for g in ("obligation", "prohibition") for w in MARKERS[g]), key=len, reverse=True))
    return F.lower(text).rlike(f"{_EDGE}(?:{words}){_END}")


def verdict(text: Column, title: Column, key: Column, level: Column, of: Column | None = None, duty: Column | None = None) -> Column:
    """(type, premise_kind, path, warnings, gate) of a unit: 'actor_cu', 'meta_cu' or 'premise'.

    A: a unit without a gate, whose title isn't one of premises or gates, is a norm: by its markers or by default. B: one
    with markers under a title of gates is a norm too; under a title of premises it stays a premise and is warned of. C: a
    gate makes it a gate; else a premise by its title; an article under a title of gates is the gate of its document, a
    clause or point there only names a role. path holds the tests' outcomes in order. level: 'article', 'clause' or 'point'.
    of and duty: the gate and the markers, where they are in columns already.
    """
    found, (by_title, kind) = gate(text, key) if of is None else of, title_class(F.coalesce(title, F.lit("")))
    duty = duties(text) if duty is None else duty
    has = found.isNotNull()
    aside = F.coalesce(by_title.isin("premise", "meta_cu"), F.lit(False))
    premise_title = F.coalesce(by_title == "premise", F.lit(False))
    none = F.lit(None).cast("string")
    nothing = F.slice(F.array(F.lit("")), 1, 0)
    some = lambda *xs: F.array(*(F.lit(x) for x in xs))
    document_gate = F.struct(F.lit("subject").alias("kind"), F.lit("document").alias("scope"), nothing.alias("targets"), nothing.alias("exclusions"), F.lit(True).alias("derivable"), F.lit(False).alias("negative"), F.lit("title").alias("note"))

    def out(type_: str, premise, path, warnings, of=None) -> Column:
        return F.struct(F.lit(type_).alias("type"), premise.alias("premise_kind"), path.alias("path"), warnings.alias("warnings"), (of if of is not None else F.when(F.lit(False), document_gate)).alias("gate"))

    warned = F.when(duty, some("title_against_markers")).otherwise(nothing)
    return (
        F.when(has, out("meta_cu", none, some("A:gate", "B:gates_others", "C:scope"), F.when(found["derivable"], nothing).otherwise(some("scope_unresolved")), found))
        .when(~aside & duty, out("actor_cu", none, some("A:markers"), nothing))
        .when(~aside, out("actor_cu", none, some("A:default"), nothing))
        .when(duty & ~premise_title, out("actor_cu", none, some("A:title", "B:markers"), nothing))
        .when(premise_title, out("premise", F.coalesce(kind, F.lit("pham_vi")), some("A:title", "B:nothing", "C:premise"), warned))
        .when(level == "article", out("meta_cu", none, some("A:title", "B:nothing", "C:article"), nothing, document_gate))
        .otherwise(out("premise", F.lit("vai_tro"), some("A:title", "B:nothing", "C:role"), nothing))
    )


def classified(units: DataFrame, text: str, title: str, key: str, level: str) -> DataFrame:
    """units with type, premise_kind, path, warnings, gate and duty; each piece of evidence is worked out once, in a step of its own."""
    step = lambda df, columns: df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
    # A generator ends a step: what it made is not worked out again for each use.
    refs = step(units, {f"__{name}": column for name, column in evidence(F.col(text)).items()})
    found = step(refs, {"__gate": gate(F.col(text), F.col(key), {n: F.col(f"__{n}") for n in ("said", "left_out", "head")}), "duty": duties(F.col(text))})
    told = step(found, {"__v": verdict(F.col(text), F.col(title), F.col(key), F.col(level), F.col("__gate"), F.col("duty"))})
    return told.select(*units.columns, "__v.*", "duty")
