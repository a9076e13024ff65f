"""What guards ask about a match's surroundings, read from a source's tokens: declarations, ancestors, names' kinds and types.

One scan gives a file's types, methods and variables; each match then looks up the innermost ones around it. There are no
type bindings: the type of a name is that of its declaration in the same file, and a name declared elsewhere has none.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

from gritmill.plans.nodes import find_nodes
from gritmill.plans.tokens import CLOSE, OPEN, lex

_LIST, _MAP, _LISTS = "array<string>", "map<string,string>", "map<string,array<string>>"
#: Columns that guards read, with their types. The first ones are found here.
FOUND = {
    "package_name": "string", "class_name": "string", "supertypes": _LIST, "fields": _LIST, "methods": _LIST,
    "method_text": "string", "return_type": "string", "parameters": _LIST, "thrown": _LIST, "enclosing_annotations": _LIST, "suppressed": _LIST,
    "ancestors": _LIST, "parent_kind": "string", "parent_text": "string",
    "element_kinds": _MAP, "types": _LISTS, "modifiers": _LISTS, "annotations": _LISTS,
}
#: These come with the input, or are null.
GIVEN = {
    "source_version": "double", "mode": "string", "null_status": _MAP, "planned_role": "string", "enclosing_roles": _LIST, "planned_values": _MAP, "enclosing_values": _MAP,
    "relations": "array<struct<kind:string,value:string,outgoing:boolean>>",
}
_MODIFIERS = set("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
_TYPES = {"class", "interface", "enum", "record"}
_NOT_TYPES = set("return throw new else case goto assert package import instanceof".split())


@dataclass
class Declared:
    """A type, method or variable: tokens first to last, and what stands in its head."""

    kind: str
    name: str
    first: int
    last: int
    type: str = ""
    modifiers: list[str] = field(default_factory=list)
    annotations: list[str] = field(default_factory=list)
    suppressed: list[str] = field(default_factory=list)
    supers: list[str] = field(default_factory=list)
    thrown: list[str] = field(default_factory=list)
    parameters: list[Declared] = field(default_factory=list)


class Context:
    """The surroundings of any interval of one source text."""

    def __init__(self, text: str):
        self.text, self.toks = text, lex(text)
        self.t = [x for x, _, _ in self.toks]
        self.close, stack = {}, []
        for i, x in enumerate(self.t):
            if x in OPEN:
                stack.append(i)
            elif x in CLOSE and stack:
                self.close[stack.pop()] = i
        self.nodes = find_nodes(text)
        self.types: list[Declared] = []
        self.methods: list[Declared] = []
        self.variables: list[Declared] = []  # fields and locals; last is the end of their scope
        self.package = "".join(self.t[1 : self.t.index(";")]) if self.t[:1] == ["package"] and ";" in self.t else ""
        self._members(0, len(self.t), None)
        self.starts = [s for _, s, _ in self.toks]

    def _names(self, a: int, z: int) -> list[str]:
        """Simple names of a comma-separated list of types."""
        out, depth, last = [], 0, ""
        for x in [*self.t[a:z], ","]:
            depth += (x == "<") - x.count(">")
            if x == "," and depth <= 0:
                out += [last] if last else []
                last = ""
            elif depth <= 0 and (x[0].isalpha() or x[0] in "_$"):
                last = x
        return out

    def _head(self, a: int, z: int) -> tuple[int, list[str], list[str], list[str]]:
        """First token after modifiers and annotations, these, and the keys of suppressed warnings."""
        modifiers, annotations, keys = [], [], []
        while a < z:
            if self.t[a] in _MODIFIERS:
                modifiers.append(self.t[a])
                a += 1
            elif self.t[a] == "@" and a + 1 < z and self.t[a + 1] != "interface":
                b = a + 2
                while b + 1 < z and self.t[b] == ".":
                    b += 2
                annotations.append(self.t[b - 1])
                end = self.close.get(b, b) + 1 if b < z and self.t[b] == "(" else b
                if annotations[-1] == "SuppressWarnings":
                    keys += [x[1:-1] for x in self.t[b:end] if x.startswith('"')]
                a = end
            else:
                break
        return a, modifiers, annotations, keys

    def _variable(self, kind: str, a: int, z: int, first: int, scope: int) -> Declared | None:
        """A variable from its head's tokens: modifiers, type, name."""
        b, modifiers, annotations, _ = self._head(a, z)
        while z - b > 2 and self.t[z - 1] == "]":
            z -= 2
        name = self.t[z - 1] if z - b >= 2 else ""
        if not name or not (name[0].isalpha() or name[0] in "_$") or self.t[b] in _NOT_TYPES or any(x[0] in "\"'(){};=" for x in self.t[b:z]):
            return None
        return Declared(kind, name, first, scope, "".join(self.t[b : z - 1]), modifiers, annotations)

    def _members(self, a: int, z: int, owner: Declared | None) -> None:
        """Declarations at this level: of a file, or of a type's body."""
        i = start = a
        while i < z:
            x = self.t[i]
            if x in _TYPES and i + 1 < z and (self.t[i + 1][0].isalpha() or self.t[i + 1][0] in "_$") and self.t[i - 1 : i] != ["."]:
                _, modifiers, annotations, keys = self._head(start, i)
                body = next((k for k in range(i, z) if self.t[k] == "{"), z)
                end = self.close.get(body, z - 1)
                marks, depth = [], 0
                for k in range(i, body):
                    depth += (self.t[k] == "<") - self.t[k].count(">")
                    if depth == 0 and self.t[k] in ("extends", "implements", "permits"):
                        marks.append(k)
                marks.append(body)
                supers = [n for k, w in zip(marks, marks[1:], strict=False) if self.t[k] != "permits" for n in self._names(k + 1, w)]
                one = Declared("TYPE", self.t[i + 1], start, end, modifiers=modifiers, annotations=annotations, suppressed=keys, supers=supers)
                self.types.append(one)
                self._members(body + 1, end, one)
                i = start = end + 1
            elif x == "(" and owner is not None and "=" not in self.t[start:i] and i > start and (self.t[i - 1][0].isalpha() or self.t[i - 1][0] in "_$") and not self.t[i - 2 : i - 1] == ["@"] and self._head(start, i)[0] < i:
                i = start = self._method(start, i, z, owner)
            elif x == "{" and "=" in self.t[start:i]:  # an initial value
                i = self.close.get(i, z) + 1
            elif x == ";" or x == "{":
                if owner is not None and x == ";":
                    self._field(start, i, owner)
                elif x == "{" and owner is not None:
                    self._locals(i + 1, self.close.get(i, z))
                i = start = (self.close.get(i, z) if x == "{" else i) + 1
            else:
                i = self.close.get(i, i) + 1 if x in "([" and len(x) == 1 else i + 1

    def _field(self, a: int, z: int, owner: Declared) -> None:
        end = next((k for k in range(a, z) if self.t[k] == "="), z)
        if one := self._variable("FIELD", a, end, owner.first, owner.last):
            self.variables.append(one)

    def _method(self, start: int, paren: int, z: int, owner: Declared) -> int:
        b, modifiers, annotations, keys = self._head(start, paren)
        end = self.close.get(paren, z - 1)
        stop = next((k for k in range(end + 1, z) if self.t[k] in ("{", ";")), z - 1)
        last = self.close.get(stop, z - 1) if self.t[stop] == "{" else stop
        thrown = self._names(self.t.index("throws", end, stop) + 1, stop) if "throws" in self.t[end:stop] else []
        result = self.t[b : paren - 1]
        if result[:1] == ["<"]:  # type parameters
            result = result[result.index(">") + 1 :] if ">" in result else result
        kind = "METHOD" if result else "CONSTRUCTOR"
        one = Declared(kind, self.t[paren - 1], start, last, "".join(result), modifiers, annotations, keys, thrown=thrown)
        k = at = paren + 1
        depth = 0
        while k <= end:
            depth += (self.t[k] == "<") - self.t[k].count(">")
            if self.t[k] == "," and depth == 0 or k == end:
                if p := self._variable("PARAMETER", at, k, start, last):
                    one.parameters.append(p)
                at = k + 1
            k = self.close.get(k, k) + 1 if self.t[k] in "([{" and k != end else k + 1
        self.methods.append(one)
        if self.t[stop] == "{":
            self._locals(stop + 1, last)
        return last + 1

    def _locals(self, a: int, z: int) -> None:
        """Local variables of a block: statements and headers that begin with a type and a name; their scope is the block."""
        blocks, i = [z], a
        while i < z:
            while i >= blocks[-1] and len(blocks) > 1:
                blocks.pop()
            x = self.t[i]
            if x == "{":
                blocks.append(self.close.get(i, z))
            if i == a or self.t[i - 1] in ("{", "}", ";", "("):
                end = next((k for k in range(i, min(i + 24, z)) if self.t[k] in ("=", ":", ";", ")", "(", "{", "->")), None)
                if end and self.t[end] in ("=", ":", ";") and (one := self._variable("LOCAL_VARIABLE", i, end, i, blocks[-1])):
                    self.variables.append(one)
            i += 1

    def around(self, start: int, end: int, bindings: dict[str, list[str]]) -> tuple:
        """Values of FOUND for the text from start to end."""
        i = max(bisect_right(self.starts, start) - 1, 0)
        inner = lambda rows: max((r for r in rows if r.first <= i <= r.last), key=lambda r: r.first, default=None)
        owner, method = inner(self.types), inner(self.methods)
        if owner and method and method.first < owner.first:
            method = None
        over = [n for n in self.nodes if n[8] <= start and n[9] >= end and (n[8], n[9]) != (start, end)]
        near = over[-1] if over else None
        declares = [v for v in self.variables if v.kind == "LOCAL_VARIABLE" and v.first <= i and self._assigned(v, i)]
        kind = "LOCAL_VARIABLE" if declares and (near is None or near[8] <= self.starts[declares[-1].first]) and near[3:4] != ("TRY_RESOURCES",) else near[3] if near else None
        marks = [r for r in (*self.types, *self.methods) if r.first <= i <= r.last]
        element_kinds, types, modifiers, annotations = {}, {}, {}, {}
        for name, items in bindings.items():
            found = self._declared(items[0], i, owner, method) if len(items) == 1 else None
            if found:
                element_kinds[name], modifiers[name], annotations[name] = found.kind, found.modifiers, found.annotations
                if found.type:
                    types[name] = [found.type, *([found.type.split("<")[0].split(".")[-1]] if not found.type.isidentifier() else [])]
        own = lambda rows, k: [r.name for r in rows if r.kind == k and owner and owner.first <= r.first and r.last <= owner.last] if owner else []
        return (
            self.package, owner and (f"{self.package}.{owner.name}" if self.package else owner.name), owner.supers if owner else [], own(self.variables, "FIELD"), own(self.methods, "METHOD"),
            self.text[self.starts[method.first] : self.toks[min(method.last, len(self.toks) - 1)][2]] if method else None, method and method.type, [p.type for p in method.parameters] if method else None, method.thrown if method else [],
            [x for r in marks for x in r.annotations], [x for r in marks for x in r.suppressed],
            [n[3] for n in over], kind, near and near[5], element_kinds, types, modifiers, annotations,
        )

    def _assigned(self, v: Declared, i: int) -> bool:
        """Whether the token is the first of the variable's initial value."""
        k = v.first
        while k < i and self.t[k] != "=":
            k += 1
        return k + 1 == i and self.t[k] == "="

    def _declared(self, name: str, i: int, owner: Declared | None, method: Declared | None) -> Declared | None:
        """The innermost declaration of a simple name that can be seen at a token: local, parameter, field, method, type."""
        name = name.removeprefix("this.")
        seen = [v for v in self.variables if v.name == name and v.kind == "LOCAL_VARIABLE" and v.first <= i <= v.last]
        seen = seen or [p for p in (method.parameters if method else ()) if p.name == name]
        seen = seen or [v for v in self.variables if v.name == name and v.kind == "FIELD" and v.first <= i <= v.last]
        seen = seen or [m for m in self.methods if m.name == name.split("(")[0] and owner and owner.first <= m.first <= owner.last and (name == m.name or name.endswith(")"))]
        seen = seen or [t for t in self.types if t.name == name]
        return max(seen, key=lambda v: v.first, default=None)
