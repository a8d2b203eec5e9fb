"""Recursive-descent parser for ES2022, JSX and the parts of TypeScript that leave run-time code.

Types are read and dropped. A node has a kind, its lines and named fields; lists, nodes and scalars are
its values. Files that the parser does not take raise JsError.
"""

from __future__ import annotations

from codeloom.jsast.scan import JsError, Scanner, Token, operand_after


class Node:
    __slots__ = ("kind", "line", "end", "fields")

    def __init__(self, kind: str, line: int, end: int, fields: dict):
        self.kind, self.line, self.end, self.fields = kind, line, end, fields

    def get(self, name, default=None):
        return self.fields.get(name, default)


# Binding strength of the binary operators.
STRENGTH = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7,
    "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9,
    "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
MODIFIERS = frozenset("public private protected readonly declare abstract override static async get set accessor".split())
PATTERN_OF = {"ObjectExpression": "ObjectPattern", "ArrayExpression": "ArrayPattern", "SpreadElement": "RestElement"}


class Parser:
    def __init__(self, source: str, line: int = 1, typed: bool = True):
        self.scan = Scanner(source, line)
        self.source = source
        self.typed = typed
        self.no_in = False
        self.last_line = line
        self.operand = True
        self.pos = 0
        self.tok: Token = self.scan.token(0, True)

    # ------------------------------------------------------------ tokens

    def advance(self) -> Token:
        t = self.tok
        # other tokens end on the line they begin on
        self.last_line = self.scan.line_at(t.end - 1) if t.kind in ("string", "template") else t.line
        self.operand = operand_after(t)
        self.pos = t.end
        self.tok = self.scan.token(t.end, self.operand)
        return t

    def state(self):
        return self.tok, self.pos, self.operand, self.last_line, self.no_in

    def back(self, state) -> None:
        self.tok, self.pos, self.operand, self.last_line, self.no_in = state

    def peek(self) -> Token:
        return self.scan.token(self.tok.end, operand_after(self.tok))

    def at(self, *texts: str) -> bool:
        return self.tok.kind in ("punct", "keyword", "name") and self.tok.text in texts

    def eat(self, text: str) -> bool:
        if self.at(text):
            self.advance()
            return True
        return False

    def need(self, text: str) -> Token:
        if not self.at(text):
            raise JsError(f"line {self.tok.line}: {text!r} expected, {self.tok.text[:20]!r} found")
        return self.advance()

    def split_angle(self) -> None:
        """Read one > off a token such as >> or >=."""
        if self.tok.kind == "punct" and self.tok.text.startswith(">"):
            t = self.tok
            self.tok = Token("punct", ">", t.start, t.start + 1, t.line, t.after_newline)

    def semicolon(self) -> None:
        if self.eat(";") or self.at("}") or self.tok.kind == "end" or self.tok.after_newline:
            return
        raise JsError(f"line {self.tok.line}: {self.tok.text[:20]!r} where a statement should end")

    def node(self, kind: str, line: int, /, **fields) -> Node:
        return Node(kind, line, max(line, self.last_line), fields)

    def name(self) -> Node:
        t = self.tok
        if t.kind not in ("name", "keyword") or (t.kind == "keyword" and t.text not in ("this",)):
            raise JsError(f"line {t.line}: a name expected, {t.text[:20]!r} found")
        self.advance()
        return self.node("Identifier", t.line, name=t.text)

    # ------------------------------------------------------------ statements

    def program(self) -> Node:
        body = []
        while self.tok.kind != "end":
            body += self.statement()
        return self.node("Program", self.scan.first_line, body=body)

    def block(self) -> Node:
        line = self.need("{").line
        body = []
        while not self.at("}"):
            if self.tok.kind == "end":
                raise JsError(f"line {line}: the block does not end")
            body += self.statement()
        self.need("}")
        return self.node("BlockStatement", line, body=body)

    def one(self) -> Node:
        """A statement as a body; an erased one leaves an empty statement."""
        line = self.tok.line
        found = self.statement()
        return found[0] if found else self.node("EmptyStatement", line)

    def statement(self) -> list[Node]:
        t = self.tok
        line = t.line
        if t.kind == "punct":
            if t.text == "{":
                return [self.block()]
            if t.text == ";":
                self.advance()
                return [self.node("EmptyStatement", line)]
            if t.text == "@":
                decorators = self.decorators()
                found = self.statement()
                target = found[0].get("declaration", found[0]) if found else None
                if target is not None:
                    target.fields["decorators"] = decorators
                return found
        if t.kind == "keyword":
            method = getattr(self, f"s_{t.text}", None)
            if t.text == "import" and self.peek().text in ("(", "."):
                method = None
            if t.text == "const" and self.peek().text == "enum":
                self.advance()
                return self.enum(line)
            if t.text == "enum":
                return self.enum(line)
            if method is not None:
                return [x for x in [method(line)] if x is not None]
        if t.kind == "name":
            after = self.peek()
            if t.text == "async" and after.text == "function" and not after.after_newline:
                self.advance()
                return [self.function(line, True, True)]
            if t.text == "let" and (after.kind == "name" or after.text in ("[", "{")):
                return [self.s_let(line)]
            if after.text == ":" and after.kind == "punct":
                label = self.name()
                self.advance()
                return [self.node("LabeledStatement", line, label=label, body=self.one())]
            if self.typed and (erased := self.typed_statement(t, after)) is not None:
                return erased
        expr = self.expression()
        self.semicolon()
        if expr.kind == "StringLiteral":
            return [self.node("Directive", line, value=expr)]
        return [self.node("ExpressionStatement", line, expression=expr)]

    def typed_statement(self, t: Token, after: Token) -> list[Node] | None:
        """Statements of types alone; None if this is none of them."""
        if after.after_newline or after.kind not in ("name", "keyword", "string"):
            return None
        if t.text == "type" and after.kind == "name":
            self.advance()
            self.name()
            self.type_params()
            self.need("=")
            self.type()
            self.semicolon()
            return []
        if t.text == "interface" and after.kind == "name":
            self.advance()
            self.name()
            self.type_params()
            while not self.at("{"):
                self.advance()
            self.skip_braces()
            return []
        if t.text == "declare":
            self.advance()
            if self.at("global", "module", "namespace"):
                while not self.at("{"):
                    self.advance()
                self.skip_braces()
            else:
                self.statement_without_body()
            return []
        if t.text in ("namespace", "module"):
            self.advance()
            while not self.at("{"):
                self.advance()
            return [self.block()]
        if t.text == "abstract" and after.text == "class":
            self.advance()
            return [self.class_(self.tok.line, True)]
        return None

    def statement_without_body(self) -> None:
        if self.at("class", "abstract"):
            while not self.at("{"):
                self.advance()
            self.skip_braces()
            return
        if self.at("function"):
            self.advance()
            self.name()
            self.signature()
            self.semicolon()
            return
        self.statement()

    def skip_braces(self) -> None:
        self.need("{")
        depth = 1
        while depth:
            if self.tok.kind == "end":
                raise JsError(f"line {self.tok.line}: a brace is not closed")
            t = self.advance()
            if t.kind == "punct":
                depth += (t.text == "{") - (t.text == "}")

    def enum(self, line: int) -> list[Node]:
        self.need("enum")
        name = self.name()
        self.need("{")
        members = []
        while not self.at("}"):
            key, computed = self.key()
            value = self.assignment() if self.eat("=") else None
            members.append(self.node("EnumMember", line, key=key, computed=computed, value=value))
            if not self.eat(","):
                break
        self.need("}")
        return [self.node("EnumDeclaration", line, id=name, members=members)]

    def declarations(self, kind: str, line: int) -> Node:
        found = []
        while True:
            at = self.tok.line
            target = self.binding()
            self.eat("!")
            self.annotation()
            init = self.assignment() if self.eat("=") else None
            found.append(self.node("VariableDeclarator", at, id=target, init=init))
            if not self.eat(","):
                break
        return self.node("VariableDeclaration", line, kind=kind, declarations=found)

    def s_var(self, line: int) -> Node:
        kind = self.advance().text
        found = self.declarations(kind, line)
        self.semicolon()
        return found

    s_const = s_let = s_var

    def s_function(self, line: int) -> Node | None:
        return self.function(line, True, False)

    def s_class(self, line: int) -> Node:
        return self.class_(line, True)

    def s_if(self, line: int) -> Node:
        self.advance()
        test = self.paren()
        then = self.one()
        other = self.one() if self.eat("else") else None
        return self.node("IfStatement", line, test=test, consequent=then, alternate=other)

    def paren(self) -> Node:
        self.need("(")
        expr = self.expression()
        self.need(")")
        return expr

    def s_for(self, line: int) -> Node:
        self.advance()
        waits = self.eat("await")
        self.need("(")
        init = None
        self.no_in = True
        at = self.tok.line
        if self.at("var", "const") or (self.at("let") and self.peek().text not in ("in", "of", "=", ";")):
            init = self.declarations(self.advance().text, at)
        elif not self.at(";"):
            init = self.expression()
        self.no_in = False
        if self.at("of", "in"):
            word = self.advance().text
            right = self.assignment() if word == "of" else self.expression()
            self.need(")")
            left = self.pattern(init)
            fields = {"left": left, "right": right, "body": self.one()}
            if word == "of":
                fields["await"] = waits
            return self.node("ForOfStatement" if word == "of" else "ForInStatement", line, **fields)
        self.need(";")
        test = None if self.at(";") else self.expression()
        self.need(";")
        update = None if self.at(")") else self.expression()
        self.need(")")
        return self.node("ForStatement", line, init=init, test=test, update=update, body=self.one())

    def s_while(self, line: int) -> Node:
        self.advance()
        return self.node("WhileStatement", line, test=self.paren(), body=self.one())

    def s_with(self, line: int) -> Node:
        self.advance()
        return self.node("WithStatement", line, object=self.paren(), body=self.one())

    def s_do(self, line: int) -> Node:
        self.advance()
        body = self.one()
        self.need("while")
        test = self.paren()
        self.eat(";")
        return self.node("DoWhileStatement", line, body=body, test=test)

    def s_return(self, line: int) -> Node:
        self.advance()
        ends = self.at(";", "}") or self.tok.kind == "end" or self.tok.after_newline
        value = None if ends else self.expression()
        self.semicolon()
        return self.node("ReturnStatement", line, argument=value)

    def s_throw(self, line: int) -> Node:
        self.advance()
        value = self.expression()
        self.semicolon()
        return self.node("ThrowStatement", line, argument=value)

    def s_break(self, line: int) -> Node:
        word = self.advance().text
        label = self.name() if self.tok.kind == "name" and not self.tok.after_newline else None
        self.semicolon()
        return self.node("BreakStatement" if word == "break" else "ContinueStatement", line, label=label)

    s_continue = s_break

    def s_debugger(self, line: int) -> Node:
        self.advance()
        self.semicolon()
        return self.node("DebuggerStatement", line)

    def s_try(self, line: int) -> Node:
        self.advance()
        body, handler, final = self.block(), None, None
        if self.at("catch"):
            at = self.advance().line
            param = None
            if self.eat("("):
                param = self.binding()
                self.annotation()
                self.need(")")
            handler = self.node("CatchClause", at, param=param, body=self.block())
        if self.eat("finally"):
            final = self.block()
        return self.node("TryStatement", line, block=body, handler=handler, finalizer=final)

    def s_switch(self, line: int) -> Node:
        self.advance()
        value = self.paren()
        self.need("{")
        cases = []
        while not self.eat("}"):
            at = self.tok.line
            test = None
            if self.eat("case"):
                test = self.expression()
            else:
                self.need("default")
            self.need(":")
            body = []
            while not self.at("case", "default", "}"):
                body += self.statement()
            cases.append(self.node("SwitchCase", at, test=test, consequent=body))
        return self.node("SwitchStatement", line, discriminant=value, cases=cases)

    def s_import(self, line: int) -> Node | None:
        self.advance()
        typed = self.at("type") and self.peek().text not in (",", "from", "=")
        if typed:
            self.advance()
        found = []
        if self.tok.kind == "string":
            source = self.primary()
        else:
            while not self.at("from"):
                at = self.tok.line
                if self.eat("*"):
                    self.need("as")
                    found.append(self.node("ImportNamespaceSpecifier", at, local=self.name()))
                elif self.at("{"):
                    found += self.specifiers("ImportSpecifier", "imported", "local")
                else:
                    found.append(self.node("ImportDefaultSpecifier", at, local=self.name()))
                if self.eat("="):  # import x = require("y")
                    value = self.assignment()
                    self.semicolon()
                    return self.node("ImportEquals", line, specifiers=found, source=value)
                if not self.eat(","):
                    break
            self.need("from")
            source = self.primary()
        if self.at("with", "assert") and not self.tok.after_newline:
            self.advance()
            self.primary()
        self.semicolon()
        return None if typed else self.node("ImportDeclaration", line, specifiers=found, source=source)

    def specifiers(self, kind: str, outer: str, inner: str) -> list[Node]:
        self.need("{")
        found = []
        while not self.at("}"):
            at = self.tok.line
            if self.at("type") and self.peek().text not in (",", "}", "as"):
                self.advance()
            a = self.module_name()
            b = self.module_name() if self.eat("as") else a
            found.append(self.node(kind, at, **{outer: a, inner: b}))
            if not self.eat(","):
                break
        self.need("}")
        return found

    def module_name(self) -> Node:
        t = self.advance()
        if t.kind == "string":
            return self.node("StringLiteral", t.line, value=t.text)
        if t.kind not in ("name", "keyword"):
            raise JsError(f"line {t.line}: a name expected, {t.text[:20]!r} found")
        return self.node("Identifier", t.line, name=t.text)

    def s_export(self, line: int) -> Node | None:
        self.advance()
        if self.eat("default"):
            at = self.tok.line
            if self.at("function"):
                value = self.function(at, True, False)
            elif self.at("async") and self.peek().text == "function":
                self.advance()
                value = self.function(at, True, True)
            elif self.at("class", "@", "abstract"):
                marks = self.decorators() if self.at("@") else None
                self.eat("abstract")
                value = self.class_(self.tok.line, True)
                if marks:
                    value.fields["decorators"] = marks
            else:
                value = self.assignment()
                self.semicolon()
            return value and self.node("ExportDefaultDeclaration", line, declaration=value)
        if self.eat("="):
            value = self.assignment()
            self.semicolon()
            return self.node("ExportAssignment", line, expression=value)
        if self.at("type") and self.peek().text in ("{", "*"):
            self.advance()
            self.s_export_from(line)
            return None
        if self.at("{", "*"):
            return self.s_export_from(line)
        found = self.statement()
        return self.node("ExportNamedDeclaration", line, declaration=found[0]) if found else None

    def s_export_from(self, line: int) -> Node:
        found, source = [], None
        if self.eat("*"):
            if self.eat("as"):
                found = [self.node("ExportNamespaceSpecifier", line, exported=self.module_name())]
        else:
            found = self.specifiers("ExportSpecifier", "local", "exported")
        if self.eat("from"):
            source = self.primary()
            if self.at("with", "assert") and not self.tok.after_newline:
                self.advance()
                self.primary()
        self.semicolon()
        return self.node("ExportNamedDeclaration" if found else "ExportAllDeclaration", line, specifiers=found, source=source)

    # ------------------------------------------------------------ functions and classes

    def function(self, line: int, declared: bool, is_async: bool) -> Node | None:
        self.need("function")
        star = self.eat("*")
        name = self.name() if self.tok.kind == "name" else None
        params = self.signature()
        if not self.at("{") and declared and self.typed:  # an overload: types alone
            self.semicolon()
            return None
        fields = {"id": name, "params": params, "body": self.body(), "async": is_async, "generator": star}
        return self.node("FunctionDeclaration" if declared else "FunctionExpression", line, **fields)

    def body(self) -> Node:
        kept, self.no_in = self.no_in, False
        found = self.block()
        self.no_in = kept
        return found

    def signature(self) -> list[Node]:
        """Parameters, with type parameters and the return type dropped."""
        self.type_params()
        params = self.params()
        if self.eat(":"):
            self.return_type()
        return params

    def return_type(self) -> None:
        if self.at("asserts") and self.peek().kind == "name":
            self.advance()
        self.type()
        if self.at("is"):
            self.advance()
            self.type()

    def params(self) -> list[Node]:
        kept, self.no_in = self.no_in, False
        self.need("(")
        found = []
        while not self.at(")"):
            if self.at("@"):
                self.decorators()
            while self.at("public", "private", "protected", "readonly", "override") and self.peek().kind in ("name", "punct") and self.peek().text not in (",", ")", ":", "=", "?"):
                self.advance()
            at = self.tok.line
            if self.eat("..."):
                target = self.binding()
                self.annotation()
                found.append(self.node("RestElement", at, argument=target))
            else:
                found.append(self.with_default(at))
            if not self.eat(","):
                break
        self.need(")")
        self.no_in = kept
        return [p for p in found if not (p.kind == "Identifier" and p.get("name") == "this")]

    def with_default(self, line: int) -> Node:
        target = self.binding()
        self.eat("?")
        self.annotation()
        if self.eat("="):
            return self.node("AssignmentPattern", line, left=target, right=self.assignment())
        return target

    def binding(self) -> Node:
        line = self.tok.line
        if self.eat("["):
            items = []
            while not self.at("]"):
                if self.at(","):
                    self.advance()
                    items.append(None)
                    continue
                at = self.tok.line
                items.append(self.node("RestElement", at, argument=self.binding()) if self.eat("...") else self.with_default(at))
                if not self.at("]"):
                    self.need(",")
            self.need("]")
            return self.node("ArrayPattern", line, elements=items)
        if self.eat("{"):
            items = []
            while not self.at("}"):
                at = self.tok.line
                if self.eat("..."):
                    items.append(self.node("RestElement", at, argument=self.binding()))
                else:
                    key, computed = self.key()
                    if self.eat(":"):
                        value, short = self.with_default(at), False
                    else:
                        value, short = key, True
                        if self.eat("="):
                            value = self.node("AssignmentPattern", at, left=key, right=self.assignment())
                    items.append(self.node("ObjectProperty", at, key=key, value=value, computed=computed, shorthand=short))
                if not self.eat(","):
                    break
            self.need("}")
            return self.node("ObjectPattern", line, properties=items)
        return self.name()

    def key(self) -> tuple[Node, bool]:
        t = self.tok
        if self.eat("["):
            kept, self.no_in = self.no_in, False
            expr = self.assignment()
            self.no_in = kept
            self.need("]")
            return expr, True
        self.advance()
        if t.kind in ("name", "keyword"):
            return self.node("Identifier", t.line, name=t.text), False
        if t.kind == "string":
            return self.node("StringLiteral", t.line, value=t.text[1:-1]), False
        if t.kind == "number":
            return self.node("NumericLiteral", t.line, value=t.text), False
        if t.kind == "private":
            return self.node("PrivateName", t.line, name=t.text), False
        raise JsError(f"line {t.line}: a key expected, {t.text[:20]!r} found")

    def decorators(self) -> list[Node]:
        found = []
        while self.at("@"):
            line = self.advance().line
            found.append(self.node("Decorator", line, expression=self.postfix(self.primary(), line, calls=True)))
        return found

    def class_(self, line: int, declared: bool) -> Node:
        self.need("class")
        name = self.name() if self.tok.kind == "name" and not self.at("implements") else None
        self.type_params()
        parent = None
        if self.eat("extends"):
            at = self.tok.line
            parent = self.postfix(self.primary(), at, calls=True)
            self.type_params()
        if self.at("implements"):
            while not self.at("{"):
                self.advance()
        self.need("{")
        members = []
        while not self.eat("}"):
            if self.eat(";"):
                continue
            member = self.member()
            if member is not None:
                members.append(member)
        body = self.node("ClassBody", line, body=members)
        return self.node("ClassDeclaration" if declared else "ClassExpression", line, id=name, superClass=parent, body=body)

    def member(self) -> Node | None:
        marks = self.decorators() if self.at("@") else []
        line = self.tok.line
        words: list[str] = []
        while self.tok.kind == "name" and self.tok.text in MODIFIERS:
            after = self.peek()
            if after.kind == "punct" and after.text in ("(", "=", ";", "}", ":", "?", "!", "<", ",") or (after.after_newline and self.tok.text not in ("static", "public", "private", "protected")):
                break
            words.append(self.advance().text)
            if words[-1] == "static" and self.at("{"):
                return self.node("StaticBlock", line, body=self.block().get("body"))
        star = self.eat("*")
        if self.at("[") and self.typed and self.index_signature():
            return None
        key, computed = self.key()
        self.eat("?") or self.eat("!")
        private = key.kind == "PrivateName"
        kind = "get" if "get" in words else "set" if "set" in words else "method"
        static = "static" in words
        if self.at("(", "<"):
            params = self.signature()
            if not self.at("{"):  # abstract, or an overload
                self.semicolon()
                return None
            if not static and not computed and key.get("name") == "constructor":
                kind = "constructor"
            found = self.node(
                "ClassPrivateMethod" if private else "ClassMethod", line, key=key, computed=computed, kind=kind, static=static,
                params=params, body=self.body(), generator=star, **{"async": "async" in words},
            )
        else:
            self.annotation()
            value = self.assignment() if self.eat("=") else None
            self.semicolon()
            if "declare" in words or "abstract" in words:
                return None
            found = self.node("ClassPrivateProperty" if private else "ClassProperty", line, key=key, computed=computed, static=static, value=value)
        if marks:
            found.fields["decorators"] = marks
        return found

    def index_signature(self) -> bool:
        kept = self.state()
        self.advance()
        if self.tok.kind == "name" and self.peek().text == ":":
            self.advance()
            self.annotation()
            if self.eat("]"):
                self.annotation()
                self.semicolon()
                return True
        self.back(kept)
        return False

    # ------------------------------------------------------------ types (read and dropped)

    def annotation(self) -> None:
        if self.typed and self.at(":"):
            self.advance()
            self.type()

    def type_params(self) -> None:
        if self.typed and self.at("<"):
            self.angle()

    def angle(self) -> None:
        self.need("<")
        while True:
            self.split_angle()
            if self.eat(">"):
                return
            if self.tok.kind == "end":
                raise JsError(f"line {self.tok.line}: type arguments do not end")
            self.eat("const") or self.eat("in") or self.eat("out")
            self.type()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            self.split_angle()
            if not self.at(">"):
                self.need(",")

    def type_args(self) -> bool:
        """Type arguments before a call, if that is what the < begins."""
        if not (self.typed and self.at("<")):
            return False
        kept = self.state()
        try:
            self.angle()
            if self.at("(", ")", "]", ":", ";", ",", ".", "?.", "{", "}", "==", "!=", "===", "!==") or self.tok.kind in ("template", "end"):
                return True
        except JsError:
            pass
        self.back(kept)
        return False

    def type(self) -> None:
        if self.at("|", "&"):
            self.advance()
        self.type_operand()
        while True:
            if self.at("|", "&"):
                self.advance()
                self.type_operand()
            elif self.at("extends") and not self.tok.after_newline and self.conditional_type():
                continue
            else:
                return

    def conditional_type(self) -> bool:
        kept = self.state()
        self.advance()
        try:
            self.type_operand()
            if self.eat("?"):
                self.type()
                self.need(":")
                self.type()
                return True
        except JsError:
            pass
        self.back(kept)
        return False

    def type_operand(self) -> None:
        while self.at("keyof", "unique", "readonly", "infer", "typeof", "abstract", "asserts") and self.peek().text not in (",", ")", ">", ";", "=", "|", "&", "]", "}"):
            self.advance()
        if self.at("new") and self.peek().text in ("(", "<"):
            self.advance()
        t = self.tok
        if self.at("<") or (self.at("(") and self.after_parens(("=>",))):
            self.type_params()
            self.params()
            self.need("=>")
            self.return_type()
            return
        if self.eat("("):
            self.type()
            self.need(")")
        elif self.at("{"):
            self.skip_braces()
        elif self.eat("["):
            while not self.at("]"):
                self.eat("...")
                if self.tok.kind == "name" and self.peek().text in (":", "?") :
                    self.advance()
                    self.eat("?")
                    if self.eat(":"):
                        self.type()
                else:
                    self.type()
                    self.eat("?")
                if not self.eat(","):
                    break
            self.need("]")
        elif self.eat("-"):
            self.advance()
        elif t.kind in ("name", "keyword", "string", "number", "template"):
            self.advance()
            if t.text == "import" and self.eat("("):
                self.type()
                self.need(")")
            while self.at("."):
                self.advance()
                self.advance()
            if self.at("<") and not self.tok.after_newline:
                self.angle()
        else:
            raise JsError(f"line {t.line}: a type expected, {t.text[:20]!r} found")
        while self.at("[") and not self.tok.after_newline:
            self.advance()
            if not self.at("]"):
                self.type()
            self.need("]")

    # ------------------------------------------------------------ expressions

    def expression(self) -> Node:
        line = self.tok.line
        first = self.assignment()
        if not self.at(","):
            return first
        items = [first]
        while self.eat(","):
            items.append(self.assignment())
        return self.node("SequenceExpression", line, expressions=items)

    def after_parens(self, texts: tuple) -> bool:
        """Whether one of these tokens follows the parentheses that open here."""
        pos, operand, depth = self.tok.start, True, 0
        try:
            while True:
                t = self.scan.token(pos, operand)
                if t.kind == "end":
                    return False
                if t.kind == "punct":
                    depth += (t.text in "([{") - (t.text in ")]}")
                    if not depth:
                        t = self.scan.token(t.end, False)
                        return t.kind == "punct" and t.text in texts
                pos, operand = t.end, operand_after(t)
        except JsError:
            return False

    def arrow(self) -> Node | None:
        """An arrow function, if one begins here."""
        t = self.tok
        line, is_async = t.line, False
        kept = self.state()
        if t.kind == "name" and t.text == "async":
            after = self.peek()
            if not after.after_newline and (after.kind == "name" or after.text in ("(", "<")):
                self.advance()
                is_async = True
        params = None
        if self.tok.kind == "name":
            after = self.peek()
            if after.text == "=>" and not after.after_newline:
                params = [self.name()]
        elif self.at("(") and self.after_parens(("=>",)):
            params = self.params()
        elif self.typed and self.at("(", "<") and (self.at("<") or self.after_parens((":",))):
            try:
                self.type_params()
                if self.at("("):
                    params = self.params()
                    if self.eat(":"):
                        self.return_type()
                if not self.at("=>"):
                    params = None
            except JsError:
                params = None
        if params is None or not self.at("=>"):
            self.back(kept)
            return None
        self.advance()
        simple = not self.at("{")
        body = self.assignment() if simple else self.body()
        return self.node("ArrowFunctionExpression", line, params=params, body=body, expression=simple, **{"async": is_async})

    def assignment(self) -> Node:
        t = self.tok
        line = t.line
        if (t.kind == "name" or (t.kind == "punct" and t.text in ("(", "<"))) and (found := self.arrow()) is not None:
            return found
        if t.kind == "name" and t.text == "yield":
            after = self.peek()
            if after.text not in ("=", ".", "=>", "+="):
                self.advance()
                star = self.eat("*")
                ends = self.tok.after_newline or self.at(")", "]", "}", ",", ";", ":") or self.tok.kind == "end"
                return self.node("YieldExpression", line, argument=None if ends else self.assignment(), delegate=star)
        left = self.conditional()
        if self.tok.kind == "punct" and self.tok.text in ASSIGN:
            op = self.advance().text
            target = self.pattern(left) if op == "=" else left
            return self.node("AssignmentExpression", line, operator=op, left=target, right=self.assignment())
        return left

    def pattern(self, node: Node | None) -> Node | None:
        """An expression read again as a target of assignment."""
        if node is None or node.kind not in ("ObjectExpression", "ArrayExpression", "SpreadElement", "ObjectProperty", "AssignmentExpression"):
            return node
        f = dict(node.fields)
        if node.kind == "AssignmentExpression":
            if f["operator"] != "=":
                return node
            return Node("AssignmentPattern", node.line, node.end, {"left": f["left"], "right": f["right"]})
        for name in ("properties", "elements"):
            if name in f:
                f[name] = [self.pattern(x) for x in f[name]]
        for name in ("argument", "value"):
            if name in f and isinstance(f[name], Node):
                f[name] = self.pattern(f[name])
        return Node(PATTERN_OF.get(node.kind, node.kind), node.line, node.end, f)

    def conditional(self) -> Node:
        line = self.tok.line
        test = self.binary(0)
        if not self.at("?"):
            return test
        self.advance()
        kept, self.no_in = self.no_in, False
        then = self.assignment()
        self.no_in = kept
        self.need(":")
        return self.node("ConditionalExpression", line, test=test, consequent=then, alternate=self.assignment())

    def binary(self, least: int) -> Node:
        line = self.tok.line
        if self.tok.kind == "private":
            t = self.advance()
            left = self.node("PrivateName", line, name=t.text)
        else:
            left = self.unary()
        while True:
            t = self.tok
            if self.typed and t.kind == "name" and t.text in ("as", "satisfies") and not t.after_newline:
                self.advance()
                self.eat("const") or self.type()
                continue
            if t.kind not in ("punct", "keyword") or t.text not in STRENGTH or (t.text == "in" and self.no_in):
                return left
            power = STRENGTH[t.text]
            if power <= least and not (t.text == "**" and power == least):
                return left
            self.advance()
            right = self.binary(power - 1 if t.text == "**" else power)
            kind = "LogicalExpression" if t.text in ("&&", "||", "??") else "BinaryExpression"
            left = self.node(kind, line, operator=t.text, left=left, right=right)

    def unary(self) -> Node:
        t = self.tok
        line = t.line
        if (t.kind == "punct" and t.text in ("+", "-", "!", "~")) or (t.kind == "keyword" and t.text in ("typeof", "void", "delete")):
            self.advance()
            return self.node("UnaryExpression", line, operator=t.text, argument=self.unary(), prefix=True)
        if t.kind == "punct" and t.text in ("++", "--"):
            self.advance()
            return self.node("UpdateExpression", line, operator=t.text, argument=self.unary(), prefix=True)
        if t.kind == "name" and t.text == "await":
            after = self.peek()
            if after.kind in ("name", "keyword", "number", "string", "template", "regex") or after.text in ("(", "[", "{", "!", "+", "-") and not after.after_newline:
                if after.text not in ("in", "of", "instanceof"):
                    self.advance()
                    return self.node("AwaitExpression", line, argument=self.unary())
        found = self.postfix(self.primary(), line, calls=True)
        if self.at("++", "--") and not self.tok.after_newline:
            op = self.advance().text
            return self.node("UpdateExpression", line, operator=op, argument=found, prefix=False)
        return found

    def postfix(self, left: Node, line: int, calls: bool) -> Node:
        optional = False
        while True:
            t = self.tok
            if t.kind == "template":
                left = self.node("TaggedTemplateExpression", line, tag=left, quasi=self.template())
                continue
            if t.kind != "punct":
                return left
            if t.text == "!" and self.typed and not t.after_newline and self.peek().text != "=":
                self.advance()
                continue
            if t.text == "<" and calls and self.type_args():
                continue
            if t.text == "?.":
                if not calls:
                    return left
                self.advance()
                optional = True
                if self.at("("):
                    left = self.node("OptionalCallExpression", line, callee=left, arguments=self.arguments(), optional=True)
                    continue
                if self.at("["):
                    left = self.index(left, line, True)
                    continue
                left = self.node("OptionalMemberExpression", line, object=left, property=self.property(), computed=False, optional=True)
            elif t.text == ".":
                self.advance()
                kind = "OptionalMemberExpression" if optional else "MemberExpression"
                left = self.node(kind, line, object=left, property=self.property(), computed=False)
            elif t.text == "[":
                left = self.index(left, line, optional)
            elif t.text == "(" and calls:
                left = self.node("OptionalCallExpression" if optional else "CallExpression", line, callee=left, arguments=self.arguments())
            else:
                return left

    def index(self, left: Node, line: int, optional: bool) -> Node:
        self.need("[")
        kept, self.no_in = self.no_in, False
        expr = self.expression()
        self.no_in = kept
        self.need("]")
        return self.node("OptionalMemberExpression" if optional else "MemberExpression", line, object=left, property=expr, computed=True)

    def property(self) -> Node:
        t = self.advance()
        if t.kind == "private":
            return self.node("PrivateName", t.line, name=t.text)
        if t.kind not in ("name", "keyword"):
            raise JsError(f"line {t.line}: a property name expected, {t.text[:20]!r} found")
        return self.node("Identifier", t.line, name=t.text)

    def arguments(self) -> list[Node]:
        kept, self.no_in = self.no_in, False
        self.need("(")
        found = []
        while not self.at(")"):
            line = self.tok.line
            found.append(self.node("SpreadElement", line, argument=self.assignment()) if self.eat("...") else self.assignment())
            if not self.eat(","):
                break
        self.need(")")
        self.no_in = kept
        return found

    def template(self) -> Node:
        t = self.tok
        parts = self.scan.template_parts(t.start)[:-1]
        expressions = []
        for a, b in parts:
            inner = Parser(self.source[a:b], self.scan.line_at(a), self.typed)
            expressions.append(inner.expression())
        self.advance()
        return self.node("TemplateLiteral", t.line, expressions=expressions)

    def primary(self) -> Node:
        t = self.tok
        line = t.line
        if t.kind == "number":
            self.advance()
            return self.node("BigIntLiteral" if t.text.endswith("n") else "NumericLiteral", line, value=t.text)
        if t.kind == "string":
            self.advance()
            return self.node("StringLiteral", line, value=t.text[1:-1])
        if t.kind == "template":
            return self.template()
        if t.kind == "regex":
            self.advance()
            return self.node("RegExpLiteral", line, pattern=t.text)
        if t.kind == "name":
            after = self.peek()
            if t.text == "async" and after.text == "function" and not after.after_newline:
                self.advance()
                return self.function(line, False, True)
            return self.name()
        if t.kind == "keyword":
            return self.word(t, line)
        if t.kind == "punct":
            if t.text == "(":
                kept, self.no_in = self.no_in, False
                found = self.paren()
                self.no_in = kept
                return found
            if t.text == "[":
                return self.array(line)
            if t.text == "{":
                return self.object(line)
            if t.text == "<":
                return self.markup()
            if t.text == "@":
                marks = self.decorators()
                found = self.class_(self.tok.line, False)
                found.fields["decorators"] = marks
                return found
        raise JsError(f"line {line}: {t.text[:20]!r} where a value should be")

    def word(self, t: Token, line: int) -> Node:
        if t.text == "function":
            return self.function(line, False, False)
        if t.text == "class":
            return self.class_(line, False)
        if t.text == "new":
            self.advance()
            if self.eat("."):
                return self.node("MetaProperty", line, property=self.property())
            at = self.tok.line
            callee = self.postfix(self.primary(), at, calls=False)
            self.type_args()
            return self.node("NewExpression", line, callee=callee, arguments=self.arguments() if self.at("(") else [])
        if t.text == "import":
            self.advance()
            if self.eat("."):
                return self.node("MetaProperty", line, property=self.property())
            return self.node("Import", line)
        kinds = {"this": "ThisExpression", "super": "Super", "null": "NullLiteral", "true": "BooleanLiteral", "false": "BooleanLiteral"}
        if t.text in kinds:
            self.advance()
            return self.node(kinds[t.text], line, **({"value": t.text == "true"} if kinds[t.text] == "BooleanLiteral" else {}))
        raise JsError(f"line {line}: {t.text!r} where a value should be")

    def array(self, line: int) -> Node:
        kept, self.no_in = self.no_in, False
        self.need("[")
        items: list[Node | None] = []
        while not self.at("]"):
            if self.eat(","):
                items.append(None)
                continue
            at = self.tok.line
            items.append(self.node("SpreadElement", at, argument=self.assignment()) if self.eat("...") else self.assignment())
            if not self.at("]"):
                self.need(",")
        self.need("]")
        self.no_in = kept
        return self.node("ArrayExpression", line, elements=items)

    def object(self, line: int) -> Node:
        kept, self.no_in = self.no_in, False
        self.need("{")
        items = []
        while not self.at("}"):
            items.append(self.entry())
            if not self.eat(","):
                break
        self.need("}")
        self.no_in = kept
        return self.node("ObjectExpression", line, properties=items)

    def entry(self) -> Node:
        line = self.tok.line
        if self.eat("..."):
            return self.node("SpreadElement", line, argument=self.assignment())
        words = []
        while self.tok.kind == "name" and self.tok.text in ("async", "get", "set"):
            after = self.peek()
            if after.kind == "punct" and after.text in (",", "}", ":", "(", "=", "<"):
                break
            words.append(self.advance().text)
        star = self.eat("*")
        start = self.tok
        key, computed = self.key()
        if self.at("(", "<"):
            kind = words[-1] if words and words[-1] != "async" else "method"
            params = self.signature()
            return self.node("ObjectMethod", line, key=key, computed=computed, kind=kind, params=params, body=self.body(), generator=star, **{"async": "async" in words})
        if self.eat(":"):
            return self.node("ObjectProperty", line, key=key, value=self.assignment(), computed=computed, shorthand=False)
        if start.kind != "name":
            raise JsError(f"line {line}: {start.text[:20]!r} is no shorthand")
        value = key
        if self.eat("="):
            value = self.node("AssignmentPattern", line, left=key, right=self.assignment())
        return self.node("ObjectProperty", line, key=key, value=value, computed=False, shorthand=True)

    # ------------------------------------------------------------ JSX

    def markup(self, inner: bool = False) -> Node:
        """An element or fragment; between tags the text is read raw."""
        line = self.need("<").line
        if self.at(">"):
            name, attributes = None, []
        else:
            name, attributes = self.tag_name(), self.attributes()
        if self.at("/"):
            self.advance()
            self.close_tag(inner)
            return self.node("JSXElement", line, name=name, attributes=attributes, children=[])
        self.split_angle()
        children, pos = [], self.tok.end
        s = self.source
        while True:
            stop = min((i for i in (s.find("<", pos), s.find("{", pos)) if i >= 0), default=-1)
            if stop < 0:
                raise JsError(f"line {line}: the element does not end")
            if s[pos:stop].strip():
                children.append(self.node("JSXText", self.scan.line_at(pos)))
            if s[stop] == "{":
                self.resume(stop)
                self.need("{")
                at = self.tok.line
                if not self.at("}"):
                    self.eat("...")
                    children.append(self.node("JSXExpressionContainer", at, expression=self.expression()))
                if not self.at("}"):
                    raise JsError(f"line {at}: '}}' expected")
                pos = self.tok.end
                continue
            if s.startswith("/", stop + 1):  # read raw: a slash here would pass for a regular expression
                close = s.find(">", stop)
                if close < 0:
                    raise JsError(f"line {line}: the element does not end")
                self.tok = Token("punct", ">", close, close + 1, self.scan.line_at(close), False)
                self.close_tag(inner)
                return self.node("JSXElement", line, name=name, attributes=attributes, children=children)
            self.resume(stop)
            children.append(self.markup(inner=True))
            pos = self.pos

    def close_tag(self, inner: bool) -> None:
        """The > that ends an element. Inside another element text follows, which is not scanned."""
        self.split_angle()
        if not self.at(">"):
            raise JsError(f"line {self.tok.line}: '>' expected, {self.tok.text[:20]!r} found")
        if inner:
            self.last_line, self.pos = self.tok.line, self.tok.end
        else:
            t = self.tok
            self.last_line, self.pos, self.operand = t.line, t.end, False
            self.tok = self.scan.token(t.end, False)

    def resume(self, pos: int) -> None:
        self.pos = pos
        self.tok = self.scan.token(pos, True)

    def tag_name(self) -> Node:
        line, text = self.tok.line, self.advance().text
        while self.at("-", ":", "."):
            text += self.advance().text + self.advance().text
        self.type_args()
        return self.node("JSXIdentifier", line, name=text)

    def attributes(self) -> list[Node]:
        found = []
        while not self.at(">", "/", ">=", ">>"):
            line = self.tok.line
            if self.eat("{"):
                self.need("...")
                found.append(self.node("JSXSpreadAttribute", line, argument=self.assignment()))
                self.need("}")
                continue
            name, value = self.tag_name(), None
            if self.eat("="):
                if self.eat("{"):
                    value = self.node("JSXExpressionContainer", line, expression=self.assignment())
                    self.need("}")
                else:
                    value = self.primary()
            found.append(self.node("JSXAttribute", line, name=name, value=value))
        return found


def parse(source: str, typed: bool = True) -> Node:
    return Parser(source, 1, typed).program()
