"""Results that may leave: a projection compiled from an allow-list of nested paths, and a check of what its columns carry.

The allow-list names fields (`triage.decision`, `actionability.actionable_issues.id`); arrays are walked through. Only
named fields are in the projection, so a field that a result gains later stays inside until someone lists it. The
check follows every output column of the analysed plan back to the columns of its sources. What is no text cannot carry
one, so counts and comparisons end a trail; text that comes from a denied source column does not pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of fields that hold texts of reviews, their authors or ids.
DENIED = frozenset("text body title author excerpt evidence label review_id reviewId reply source_url sourceUrl phrase feature fingerprint".split())

#: What a cohort's result may show of a case.
COHORT = (
    "slug app_slug name category store storefront country language url status error.message error.store error.status error.retryable "
    "fetched_reviews current_version baseline_version current_reviews baseline_reviews version_evidence.current.version version_evidence.current.count "
    "version_evidence.current.missing_reviews version_evidence.baseline.version version_evidence.baseline.count version_evidence.baseline.missing_reviews "
    "rating_drop negative_share_increase release_link.level release_link.low_rating_count release_link.explicit_count release_link.change_count "
    "release_link.linked_count release_link.linked_share actionability.low_rating_count actionability.counts actionability.software_count "
    "actionability.software_share actionability.release_linked_software_count actionability.explicit_release_software_count actionability.actionable_issues.id "
    "actionability.actionable_issues.kind actionability.actionable_issues.count actionability.actionable_issues.share "
    "actionability.actionable_issues.release_linked_count actionability.actionable_issues.explicit_release_count actionability.actionable_issues.supported "
    "triage.decision triage.blocking triage.issue_ids coverage.complaints coverage.matched coverage.rate violations.id violations.severity "
    "violations.value violations.threshold"
).split()


class PrivacyError(ValueError):
    """A path, or a column's content, that may not leave."""


def _tree(paths, denied) -> dict:
    tree: dict = {}
    for path in paths:
        node = tree
        for name in path.split("."):
            if name in denied:
                raise PrivacyError(f"{path} may not leave.")
            node = node.setdefault(name, {})
    return tree


def _inside(kind: T.DataType, name: str, denied) -> None:
    """Refuses whole structures that hold a denied field."""
    if isinstance(kind, T.ArrayType):
        _inside(kind.elementType, name, denied)
    elif isinstance(kind, T.MapType):
        _inside(kind.keyType, name, denied)
        _inside(kind.valueType, name, denied)
    elif isinstance(kind, T.StructType):
        for field in kind.fields:
            if field.name in denied:
                raise PrivacyError(f"{name} holds {field.name}, which may not leave.")
            _inside(field.dataType, f"{name}.{field.name}", denied)


def _picked(column: Column, kind: T.DataType, tree: dict, name: str, denied) -> Column:
    if not tree:
        _inside(kind, name, denied)
        return column
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _picked(x, kind.elementType, tree, name, denied))
    if not isinstance(kind, T.StructType):
        raise PrivacyError(f"{name} has no fields.")
    fields = {f.name: f.dataType for f in kind.fields}
    if missing := tree.keys() - fields.keys():
        raise PrivacyError(f"{name} has no {', '.join(sorted(missing))}.")
    parts = [_picked(column[n], fields[n], sub, f"{name}.{n}", denied).alias(n) for n, sub in tree.items()]
    return F.when(column.isNotNull(), F.struct(*parts))


def projection(schema: T.StructType, paths=COHORT, denied=DENIED) -> list[Column]:
    """The columns that hold just the fields of paths, nested as they were. PrivacyError for a path with a denied name, to
    nothing, or to a structure with a denied field inside."""
    kinds = {f.name: f.dataType for f in schema.fields}
    tree = _tree(paths, denied)
    if missing := tree.keys() - kinds.keys():
        raise PrivacyError(f"There is no {', '.join(sorted(missing))}.")
    return [_picked(F.col(f"`{n}`"), kinds[n], sub, n, denied).alias(n) for n, sub in tree.items()]


def _type(kind, path: tuple[str, ...]):
    """The JVM data type at a path of fields below kind; arrays are walked through."""
    for name in path:
        while kind.getClass().getSimpleName() == "ArrayType":
            kind = kind.elementType()
        if kind.getClass().getSimpleName() != "StructType" or name not in list(kind.fieldNames()):
            return kind
        kind = kind.apply(name).dataType()
    return kind


def _texts(kind) -> bool:
    """Whether a JVM data type holds text or bytes somewhere."""
    return any(x in kind.catalogString() for x in ("string", "binary", "variant", "char"))


#: Expressions whose fields are those of all their inputs, or of their first one.
ALL_ALIKE = {"Alias", "Coalesce", "CaseWhen", "If", "KnownNotNull", "AggregateExpression", "WindowExpression", "Concat", "CreateArray", "ArrayCompact"}
FIRST_ALIKE = {"ArrayFilter", "SortArray", "ArraySort", "CollectList", "CollectSet", "First", "Last", "Max", "Min", "MaxBy", "MinBy", "Slice", "ElementAt", "GetArrayItem", "ArrayDistinct", "Explode", "PosExplode", "TransformedArray", "GetMapValue"}


def carried(df: DataFrame) -> dict[str, set[str]]:
    """For each output column of df the names of the source columns, and of their fields, whose text it can hold.

    Trails run through every expression with a text in its type; a condition has none, a lookup's key stays behind, a
    digest shows nothing of what it is of.
    They end at the plan's leaves, which include checkpoints and tables written on the way: check those too.
    """
    expressions: dict[int, list] = {}
    leaves: dict[int, str] = {}
    todo = [df._jdf.queryExecution().analyzed()]
    each = lambda s: (s.apply(i) for i in range(s.size()))
    while todo:
        node = todo.pop()
        children = list(each(node.children()))
        todo += children
        if node.nodeName() == "Union":
            for i in range(node.output().size()):
                # A union's column can have the id of its first input's, so what both are made of is taken together.
                own = node.output().apply(i).exprId().id()
                expressions.setdefault(own, []).extend(x for child in children if (x := child.output().apply(i)).exprId().id() != own)
        elif not children:
            for a in each(node.output()):
                leaves[a.exprId().id()] = a.name()
        for e in each(node.expressions()):
            stack = [e]
            while stack:
                one = stack.pop()
                if one.getClass().getSimpleName() == "Alias":
                    expressions.setdefault(one.exprId().id(), []).append(one.child())
                stack += each(one.children())
        if node.nodeName() == "Generate":
            for a in each(node.generatorOutput()):
                expressions.setdefault(a.exprId().id(), []).append(node.generator())
        elif node.nodeName() in ("MapInArrow", "MapInPandas", "FlatMapGroupsInPandas", "FlatMapGroupsInArrow"):
            for a in each(node.output()):
                expressions.setdefault(a.exprId().id(), []).extend(each(node.children().apply(0).output()))
    known: dict[tuple, set[str]] = {}
    elements: dict[int, object] = {}  # of a lambda's variable, the array that it runs over

    def of(e, path: tuple[str, ...] = ()) -> set[str]:
        if e.resolved() and not _texts(_type(e.dataType(), path)):
            return set()
        name, children = e.getClass().getSimpleName(), list(each(e.children()))
        if name in ("AttributeReference", "OuterReference"):
            return attribute(e.exprId().id(), path)
        if name == "NamedLambdaVariable":
            return of(elements[e.exprId().id()], path) if e.exprId().id() in elements else set()
        if name in ("Sha2", "Sha1", "Md5"):
            return set()
        if name == "GetStructField":
            return of(children[0], (e.childSchema().apply(e.ordinal()).name(), *path))
        if name == "GetArrayStructFields":
            return of(children[0], (e.field().name(), *path))
        if name == "CreateNamedStruct" and path:
            own = [v for n, v in zip(children[::2], children[1::2]) if str(n.eval(None)) == path[0]]
            return set().union(*(of(v, path[1:]) for v in own)) if own else set()
        if name == "ArrayTransform":
            function = children[1]
            elements[function.arguments().apply(0).exprId().id()] = children[0]
            return of(function.function(), path)
        if name in FIRST_ALIKE:
            return of(children[0], path)
        below = path if name in ALL_ALIKE else ()
        return set().union(*(of(c, below) for c in children)) if children else set()

    def attribute(key: int, path: tuple[str, ...]) -> set[str]:
        if (key, path) not in known:
            known[key, path] = set()
            known[key, path] = ({leaves[key], *path} if key in leaves else set()).union(*(of(e, path) for e in expressions.get(key, [])))
        return known[key, path]

    return {a.name(): of(a) for a in each(df._jdf.queryExecution().analyzed().output())}


def check(df: DataFrame, denied=DENIED) -> DataFrame:
    """df, if no column of it can hold text of a denied source column; else a PrivacyError that names both."""
    for name, sources in carried(df).items():
        if found := sources & set(denied):
            raise PrivacyError(f"{name} can hold text of {', '.join(sorted(found))}.")
    return df


def write_aggregate(df: DataFrame, path: str, paths=COHORT, denied=DENIED, mode: str = "errorifexists") -> None:
    """Writes the allowed fields of df as JSON lines, after both checks."""
    check(df.select(*projection(df.schema, paths, denied)), denied).write.mode(mode).json(path)
