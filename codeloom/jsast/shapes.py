"""What the structural pass sees of a function: name, complexity, parameters, and a shape to compare by.

A function is rewritten into terms, nested tuples that begin with a label. Variables stay apart from words, and
are numbered only when a term is read out, so equal read-outs mean equal up to renaming. The plain form keeps
kinds of nodes and keys of objects. The canonical form also keeps operators and members, and adds terms that have
no order of their own:

* ``any``: operands of one logical operator, or the two sides of an equality. They are read out smallest first.
* ``each``: what walks a list and keeps or turns its elements, be it map and filter calls or a loop that pushes to
  an array. Its three parts (source, guard, element) are sealed: read out by themselves, with numbers of their own.
* ``steps``: statements of the body. They are read out along their dependences, the smallest free one first.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha1
from itertools import groupby

from codeloom.jsast.parse import Node, parse
from codeloom.jsast.patterns import absent, alone, either, find, in_turn, node, only, part, variable, word
from codeloom.jsast.scan import JsError

# Names that results show for what has none.
NAMELESS, DEFAULT, TAKEN_APART, INTRICATE = "(anonymous)", "(default)", "(destructured)", "(complex)"

METHODS = frozenset(("ObjectMethod", "ClassMethod", "ClassPrivateMethod"))
FUNCTIONS = METHODS | {"FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression"}
CLASSES = frozenset(("ClassDeclaration", "ClassExpression"))
#: Decisions that a node adds.
WEIGHTS = {
    "IfStatement": 1, "ConditionalExpression": 1, "LogicalExpression": 1, "CatchClause": 1, "ForStatement": 1, "ForInStatement": 1,
    "ForOfStatement": 1, "WhileStatement": 1, "DoWhileStatement": 1, "SwitchCase": 1,
}
#: Literals by sort; their values do not count.
SORTS = {
    "StringLiteral": "text", "TemplateLiteral": "template", "NumericLiteral": "number", "BigIntLiteral": "number",
    "BooleanLiteral": "truth", "NullLiteral": "null", "RegExpLiteral": "pattern",
}
#: Where a nameless function's name may stand, by the parent's kind.
NAMED_BY = {
    "VariableDeclarator": "id", "AssignmentExpression": "left", "ObjectProperty": "key", "ClassProperty": "key", "ClassMethod": "key",
    "ObjectMethod": "key",
}
#: What a statement of this kind writes to, if that is a plain variable.
WRITES = {"VariableDeclarator": "id", "AssignmentExpression": "left", "UpdateExpression": "argument"}
LEAVING = frozenset(("ReturnStatement", "ThrowStatement", "BreakStatement", "ContinueStatement"))
EQUALITIES = frozenset(("==", "===", "!=", "!=="))

# ---------------------------------------------------------------- patterns

_result = either(node("BlockStatement", body=only(node("ReturnStatement", argument=part("element")))), part("element"))
WALK_CALL = node(
    "CallExpression",
    callee=node("MemberExpression", computed=absent, object=part("source"), property=word("how", "map", "filter")),
    arguments=only(node("ArrowFunctionExpression", "FunctionExpression", params=only(variable("item")), body=_result)),
)
_push = node(
    "ExpressionStatement",
    expression=node(
        "CallExpression",
        callee=node("MemberExpression", computed=absent, object=variable("list"), property=word("how", "push")),
        arguments=only(part("element")),
    ),
)
WALK_LOOP = in_turn(
    node("VariableDeclaration", declarations=only(node("VariableDeclarator", id=variable("list"), init=node("ArrayExpression", elements=absent)))),
    node(
        "ForOfStatement",
        left=node("VariableDeclaration", declarations=only(node("VariableDeclarator", id=variable("item"), init=absent))),
        right=part("source"),
        body=alone(either(_push, node("IfStatement", test=part("guard"), consequent=alone(_push), alternate=absent))),
    ),
    node("ReturnStatement", argument=variable("list")),
)

# ---------------------------------------------------------------- trees


def parts_of(tree: Node) -> list[Node]:
    out = []
    for value in tree.fields.values():
        if isinstance(value, Node):
            out.append(value)
        elif isinstance(value, list):
            out += [x for x in value if isinstance(x, Node)]
    return out


def everything(tree: Node) -> list[Node]:
    out = [tree]
    for here in out:  # grows as it is walked
        out += parts_of(here)
    return out


def complexity(function: Node) -> int:
    """1 and the decisions inside, inner functions' included; a default case decides nothing."""
    return 1 + sum(WEIGHTS.get(n.kind, 0) for n in everything(function) if n.kind != "SwitchCase" or n.get("test"))


def names_of(function: Node, parent: Node | None) -> Iterator[str | None]:
    """Names that a function could go by, best first."""
    spelled = lambda n: n.get("name") if n is not None else None
    yield spelled(function.get("id"))
    if function.kind in METHODS:
        if function.get("kind") == "constructor":
            yield "constructor"
        key = function.get("key")
        if not function.get("computed") and key.kind in ("Identifier", "StringLiteral", "NumericLiteral"):
            yield str(key.get("name", key.get("value")))
    if parent is not None and parent.kind in NAMED_BY:
        yield spelled(parent.get(NAMED_BY[parent.kind]))
    if parent is not None and parent.kind == "ExportDefaultDeclaration":
        yield DEFAULT
    yield NAMELESS


def parameter(p: Node) -> str:
    mark, inner = {"AssignmentPattern": ("", "left"), "RestElement": ("...", "argument")}.get(p.kind, ("", None))
    target = p.get(inner) if inner else p
    if target.kind == "Identifier":
        return mark + target.get("name")
    return TAKEN_APART if p.kind in ("ObjectPattern", "ArrayPattern") else INTRICATE


def functions(tree: Node) -> Iterator[tuple[Node, str]]:
    """Every function with its dotted name, outermost first."""
    todo: list[tuple[Node, Node | None, str]] = [(tree, None, "")]
    while todo:
        here, parent, path = todo.pop()
        own = None
        if here.kind in FUNCTIONS:
            own = next(n for n in names_of(here, parent) if n)
            yield here, path + own
        elif here.kind in CLASSES and here.get("id") is not None:
            own = here.get("id").get("name")
        below = path if own is None else f"{path}{own}."
        todo += [(inner, here, below) for inner in reversed(parts_of(here))]


# ---------------------------------------------------------------- terms


def plain(value) -> tuple:
    """The term of a tree in the plain form."""
    return _lowered(value, plain, False)


def canonical(value) -> tuple:
    """The term of a tree in the canonical form."""
    if isinstance(value, Node):
        if (walk := find(WALK_CALL, value)) is not None:
            return _call_walk(walk)
        operator = value.get("operator")
        if value.kind == "LogicalExpression":
            return ("any", operator, *[canonical(x) for x in _operands(value, operator)])
        if value.kind == "BinaryExpression" and operator in EQUALITIES:
            return ("any", operator, canonical(value.get("left")), canonical(value.get("right")))
    return _lowered(value, canonical, True)


def _lowered(value, again, exact: bool) -> tuple:
    if value is None:
        return ("none",)
    if isinstance(value, list):
        return ("list", *map(again, value))
    if value.kind in ("Identifier", "JSXIdentifier"):
        return ("variable", value.get("name"))
    if value.kind in SORTS:
        return ("literal", SORTS[value.kind])
    fixed = not value.get("computed")
    members = exact and value.kind.endswith("MemberExpression")
    out = [value.kind]
    for field, inner in sorted(value.fields.items()):
        if fixed and isinstance(inner, Node) and inner.kind == "Identifier" and (field == "key" or field == "property" and members):
            out.append((field, inner.get("name")))
        elif isinstance(inner, (Node, list)):
            out.append((field, again(inner)))
        elif exact and inner is not None:
            out.append((field, repr(inner)))
    return tuple(out)


def _operands(value: Node, operator: str) -> Iterator[Node]:
    """Operands of a chain of one logical operator, however it is bracketed."""
    if value.kind == "LogicalExpression" and value.get("operator") == operator:
        for side in ("left", "right"):
            yield from _operands(value.get(side), operator)
    else:
        yield value


def _call_walk(walk: dict) -> tuple:
    if walk["how"] == "filter":
        return each(walk["source"], walk["item"], walk["element"], None, walk["item"])
    before = find(WALK_CALL, walk["source"])
    if before is not None and before["how"] == "filter" and find(WALK_CALL, before["source"]) is None:
        return each(before["source"], before["item"], before["element"], walk["element"], walk["item"])
    return each(walk["source"], walk["item"], None, walk["element"], walk["item"])


def each(source: Node, guarded: str, guard: Node | None, element: Node | None, item: str) -> tuple:
    """A walk over ``source``. ``guarded`` and ``item``: how guard and element call what they get; no element: itself."""
    kept = None if guard is None else sealed(canonical(guard), guarded)
    turned = sealed(("variable", item) if element is None else canonical(element), item)
    return ("each", sealed(canonical(source)), kept, turned)


def sealed(term: tuple, item: str | None = None) -> str:
    """A digest that depends on the term alone."""
    return _digest(read_out(term, {} if item is None else {item: "item"}))


def body_term(function: Node) -> tuple:
    """The body in the canonical form, a list that a loop builds up at its end as a walk."""
    body = function.get("body")
    statements = body.get("body") if body.kind == "BlockStatement" else [body]
    last = _loop_walk(statements)
    if last is not None:
        statements = statements[:-3]
    return ("body", *_stretches(statements), *([] if last is None else [last]))


def _loop_walk(statements: list[Node]) -> tuple | None:
    walk = find(WALK_LOOP, statements[-3:])
    if walk is None:
        return None
    others = [*statements[:-3], *(walk[k] for k in ("source", "element", "guard") if k in walk)]
    if any(n.kind == "Identifier" and n.get("name") == walk["list"] for tree in others for n in everything(tree)):
        return None
    made = each(walk["source"], walk["item"], walk.get("guard"), walk["element"], walk["item"])
    return ("ReturnStatement", ("argument", made))


def _stretches(statements: list[Node]) -> Iterator[tuple]:
    """Stretches of statements that may change places, and the statements that leave, which end them."""
    for leaving, stretch in groupby(statements, lambda s: s.kind in LEAVING):
        if leaving:
            yield from map(canonical, stretch)
        else:
            yield steps(list(stretch))


def steps(statements: list[Node]) -> tuple:
    """The terms of statements, each with the places of those that must come before it."""
    writer: dict[str, int] = {}
    readers: dict[str, set[int]] = defaultdict(set)
    out = []
    for i, s in enumerate(statements):
        said, written = set(), set()
        for n in everything(s):
            target = n.get(WRITES[n.kind]) if n.kind in WRITES else None
            if n.kind == "Identifier":
                said.add(n.get("name"))
            elif target is not None and target.kind == "Identifier":
                written.add(target.get("name"))
        before = {writer[name] for name in said | written if name in writer}
        for name in written:
            before |= readers.pop(name, set())
            writer[name] = i
        for name in said:
            readers[name].add(i)
        out.append((canonical(s), frozenset(before - {i})))
    return ("steps", *out)


# ---------------------------------------------------------------- read-out


def read_out(term, numbers: dict[str, str]) -> list[str]:
    """Words of a term in one order. ``numbers`` gets a number for every variable that is new."""
    out: list[str] = []
    _read(term, numbers, out)
    return out


def _read(term, numbers: dict[str, str], out: list[str]) -> None:
    if not isinstance(term, tuple):
        out.append(str(term))
        return
    label = term[0]
    if label == "variable":
        out.append(numbers.setdefault(term[1], f"${len(numbers)}"))
        return
    out.append(f"<{label}")
    if label == "any":
        out.append(term[1])
        rest = sorted(term[2:], key=lambda t: read_out(t, dict(numbers)))
    elif label == "steps":
        rest = _settled(term[1:], numbers)
    else:
        rest = term[1:]
    for t in rest:
        _read(t, numbers, out)
    out.append(">")


def _settled(found: tuple, numbers: dict[str, str]) -> list[tuple]:
    """Statements along their dependences, of those that are free the smallest first; equal ones as they stand."""
    waits = [set(before) for _, before in found]
    free = [(read_out(t, dict(numbers)), i) for i, (t, before) in enumerate(found) if not before]
    heapq.heapify(free)
    held = {i: read_out(t, dict(numbers)) for i, (t, before) in enumerate(found) if before}
    out = []
    while free:
        _, done = heapq.heappop(free)
        out.append(found[done][0])
        for i in list(held):
            waits[i].discard(done)
            if not waits[i]:
                heapq.heappush(free, (held.pop(i), i))
    return out


def _digest(words: list[str]) -> str:
    return sha1("\x00".join(words).encode("utf-8", "surrogatepass")).hexdigest()


def shape(function: Node, exact: bool) -> list[str]:
    """The words that a function is compared by."""
    if not exact:
        return read_out(plain(function), {})
    frame = Node(function.kind, function.line, function.end, {k: v for k, v in function.fields.items() if k != "body"})
    # the frame first: parameters have their numbers before operands and statements are compared
    return read_out(("function", canonical(frame), body_term(function)), {})


def _tokens(words: list[str]) -> list[str]:
    """What similarity counts: variables, words and what nodes hold, each node's words joined to one token."""
    out, here = [], []
    for w in words:
        if w[:1] == "<" or w == ">":
            if here:
                out.append(" ".join(here))
            here = [] if w == ">" else [w]
        else:
            here.append(w)
    return out


# ---------------------------------------------------------------- files


def analyze(source: str, exact: bool = False, blocks: bool = True, tokens: bool = True) -> tuple[list[dict], str | None]:
    """Rows of the functions of a file, and what stopped the parser if it stopped. exact: the canonical form."""
    try:
        tree = parse(source)
        found = list(functions(tree))
        shapes = [shape(f, exact) for f, _ in found] if blocks else []
    except (JsError, RecursionError) as e:
        return [], str(e) or type(e).__name__
    lines = source.split("\n")
    out = []
    for k, (function, name) in enumerate(found):
        row = {
            "function": name, "line": function.line, "end_line": function.end, "complexity": complexity(function),
            "params": [parameter(p) for p in function.get("params")],
        }
        if blocks:
            full = sum(bool(x.strip()) for x in lines[function.line - 1 : function.end])
            row |= {"n_lines": full, "fingerprint": _digest(shapes[k])}
            if tokens:
                row["tokens"] = _tokens(shapes[k])
        out.append(row)
    return out, None
