"""A parser for the Bash grammar, as far as static extraction needs it.

``parse`` gives the commands of a program in source order, each before the commands nested in it,
and its pipes. Text that cannot be parsed raises ``ShellSyntaxError``; nothing is guessed."""

from __future__ import annotations

from dataclasses import dataclass, field

from lucerna.schemas import DYNAMIC


class ShellSyntaxError(ValueError):
    pass


@dataclass
class Call:
    """A simple command with at least one word after its assignments."""

    start: int
    end: int
    words: list[tuple[str, bool]]


@dataclass
class Pipe:
    """One ``|`` of a pipeline: the commands left of it, and the one right of it."""

    start: int
    end: int
    left: list[Node]
    right: Node


@dataclass
class Node:
    """A piece of syntax: maybe a call, and the nodes within it in source order."""

    call: Call | None = None
    inner: list[Node] = field(default_factory=list)
    pipe: Pipe | None = None

    def calls(self):
        if self.call:
            yield self.call
        for n in self.inner:
            yield from n.calls()

    def pipes(self):
        if self.pipe:
            yield self.pipe
        for n in self.inner:
            yield from n.pipes()


# Reserved words, and builtins whose arguments are declarations.
OPENERS = frozenset("if while until for select case function { [[ ! time coproc".split())
CLOSERS = frozenset("then elif else fi do done esac } ]]".split())
DECLARATIONS = frozenset("declare local export readonly typeset nameref let".split())
META = frozenset("|&;()<>\n \t")
_REDIRECTS = ("<<<", "<<-", "&>>", "<<", "<&", "<>", ">>", ">&", ">|", "&>", "<", ">")


class _Parser:
    def __init__(self, text: str, at: int = 0):
        self.text, self.at = text, at
        self.heredocs: list[tuple[str, bool, bool, Node]] = []

    # characters

    def fail(self, what: str) -> ShellSyntaxError:
        return ShellSyntaxError(f"{1 + self.text.count(chr(10), 0, self.at)}: {what}")

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.text[i] if i < len(self.text) else ""

    def looking(self, what: str) -> bool:
        return self.text.startswith(what, self.at)

    def blanks(self) -> None:
        while True:
            c = self.peek()
            if c and c in " \t\r":
                self.at += 1
            elif self.looking("\\\n"):
                self.at += 2
            else:
                return

    def comment(self) -> None:
        if self.peek() == "#":
            end = self.text.find("\n", self.at)
            self.at = len(self.text) if end < 0 else end

    def lines(self) -> None:
        """Blanks, comments and line ends, with the here-documents that begin at a line end."""
        while True:
            self.blanks()
            self.comment()
            if self.peek() != "\n":
                return
            self.at += 1
            self.bodies()

    def bodies(self) -> None:
        for mark, quoted, tabs, node in self.heredocs:
            begin = self.at
            while True:
                if self.at >= len(self.text):
                    raise self.fail(f"here-document without its end {mark!r}")
                end = self.text.find("\n", self.at)
                end = len(self.text) if end < 0 else end
                line = self.text[self.at : end]
                stop = self.at
                self.at = min(end + 1, len(self.text))
                if (line.lstrip("\t") if tabs else line) == mark:
                    break
            if not quoted:
                node.inner += _Parser(self.text[:stop], begin).expansions()
        self.heredocs = []

    def expansions(self) -> list[Node]:
        """The commands in the expansions of the rest of the text (a here-document's body)."""
        found: list[Node] = []
        while self.at < len(self.text):
            c = self.peek()
            if c == "\\":
                self.at += 2
            elif c in "$`":
                found += self.expansion()[1]
            else:
                self.at += 1
        return found

    # words

    def reserved(self) -> str:
        """The unquoted word ahead, if it ends at a blank or operator; not consumed."""
        end = self.at
        while end < len(self.text) and self.text[end] not in META:
            end += 1
        return self.text[self.at : end]

    def expect(self, word: str) -> None:
        self.lines()
        if self.reserved() != word:
            raise self.fail(f"expected {word!r}")
        self.at += len(word)

    def single(self) -> str:
        end = self.text.find("'", self.at + 1)
        if end < 0:
            raise self.fail("single quote without its end")
        value = self.text[self.at + 1 : end]
        self.at = end + 1
        return value

    def ansi(self) -> str:
        """``$'...'``: as written, escapes kept."""
        self.at += 2
        begin = self.at
        while self.peek() != "'":
            if not self.peek():
                raise self.fail("quote without its end")
            self.at += 2 if self.peek() == "\\" else 1
        self.at += 1
        return self.text[begin : self.at - 1]

    def double(self) -> tuple[str, bool, list[Node]]:
        self.at += 1
        value, dynamic, inner = "", False, []
        while True:
            c = self.peek()
            if not c:
                raise self.fail("double quote without its end")
            if c == '"':
                self.at += 1
                return value, dynamic, inner
            if c == "\\":
                value += "" if self.peek(1) == "\n" else self.text[self.at : self.at + 2]
                self.at += 2
            elif c in "$`":
                literal, nodes = self.expansion()
                value += literal if literal is not None else DYNAMIC
                dynamic |= literal is None
                inner += nodes
            else:
                value += c
                self.at += 1

    def expansion(self) -> tuple[str | None, list[Node]]:
        """At ``$`` or a backquote: (None, nested commands), or the text of a ``$`` that expands nothing."""
        if self.peek() == "`":
            begin, self.at = self.at, self.at + 1
            while self.peek() != "`":
                if not self.peek():
                    raise self.fail("backquote without its end")
                self.at += 2 if self.peek() == "\\" else 1
            self.at += 1
            # same length, so that places in the text stay right
            body = self.text[: self.at - 1].replace("\\`", " `")
            return None, self.nested(body, begin + 1)
        if self.looking("$((") and (end := self.arithmetic()) is not None:
            begin, self.at = self.at + 3, end
            return None, _Parser(self.text[: end - 2], begin).expansions()
        if self.looking("$("):
            self.at += 2
            inner = self.statements((")",))
            if self.peek() != ")":
                raise self.fail("command substitution without its end")
            self.at += 1
            return None, inner
        if self.looking("${"):
            return None, self.braced()
        if self.looking("$["):
            return None, self.balanced("[", "]")
        c = self.peek(1)
        if c and (c.isalpha() or c == "_"):
            self.at += 2
            while (c := self.peek()) and (c.isalnum() or c == "_"):
                self.at += 1
            return None, []
        if c and (c.isdigit() or c in "@*#?-$!"):
            self.at += 2
            return None, []
        self.at += 1
        return "$", []

    def nested(self, text: str, begin: int) -> list[Node]:
        p = _Parser(text, begin)
        found = p.statements(())
        if p.at < len(p.text):
            raise self.fail("unexpected text in a command substitution")
        return found

    def arithmetic(self) -> int | None:
        """The end of ``$((...))`` or ``((...))`` from here, if the brackets close as ``))``."""
        depth, i = 0, self.at + (1 if self.peek() == "$" else 0)
        while i < len(self.text):
            c = self.text[i]
            if c == "\\":
                i += 1
            elif c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
                if depth == 0:
                    return i + 1 if self.text[i - 1] == ")" else None
            i += 1
        return None

    def braced(self) -> list[Node]:
        self.at += 2
        inner: list[Node] = []
        while self.peek() != "}":
            c = self.peek()
            if not c:
                raise self.fail("parameter expansion without its end")
            if c == "\\":
                self.at += 2
            elif c == "'":
                self.single()
            elif c == '"':
                inner += self.double()[2]
            elif c in "$`":
                inner += self.expansion()[1]
            else:
                self.at += 1
        self.at += 1
        return inner

    def balanced(self, opener: str, closer: str) -> list[Node]:
        """From a bracket to its partner, through quotes and expansions."""
        self.at = self.text.index(opener, self.at) + 1
        depth, inner = 1, []
        while depth:
            c = self.peek()
            if not c:
                raise self.fail(f"{opener!r} without its end")
            if c == "'":
                self.single()
            elif c == '"':
                inner += self.double()[2]
            elif c in "$`":
                inner += self.expansion()[1]
            else:
                depth += (c == opener) - (c == closer)
                self.at += 2 if c == "\\" else 1
        return inner

    def word(self) -> tuple[str, bool, list[Node]]:
        """(value with dynamic parts marked, whether there are any, nested commands)."""
        value, dynamic, inner, begin = "", False, [], self.at
        while c := self.peek():
            if c in "<>" and self.peek(1) == "(" and (self.at == begin or value):
                self.at += 2
                inner += self.statements((")",))
                if self.peek() != ")":
                    raise self.fail("process substitution without its end")
                self.at += 1
                value, dynamic = value + DYNAMIC, True
            elif c in "@?*+!" and self.peek(1) == "(":
                inner += self.balanced("(", ")")
                value, dynamic = value + DYNAMIC, True
            elif c in META:
                break
            elif c == "'":
                value += self.single()
            elif c == '"':
                literal, some, nodes = self.double()
                value, dynamic, inner = value + literal, dynamic or some, inner + nodes
            elif self.looking("$'"):
                value += self.ansi()
            elif self.looking('$"'):
                self.at += 1
            elif c == "\\":
                value += "" if self.peek(1) == "\n" else self.text[self.at : self.at + 2]
                self.at += 2
            elif c in "$`":
                literal, nodes = self.expansion()
                value += literal if literal is not None else DYNAMIC
                dynamic |= literal is None
                inner += nodes
            else:
                value += c
                self.at += 1
        return value, dynamic, inner

    # commands

    def statements(self, stops: tuple[str, ...]) -> list[Node]:
        """Commands up to one of ``stops`` (reserved words or ``)``, ``;;``), which is not consumed."""
        found: list[Node] = []
        while True:
            self.lines()
            if not self.peek():
                return found
            if self.peek() == ")" or self.looking(";;") or self.looking(";&"):
                if any(s in (")", ";;") for s in stops):
                    return found
                raise self.fail(f"unexpected {self.peek()!r}")
            word = self.reserved()
            if word in CLOSERS:
                if word in stops:
                    return found
                raise self.fail(f"unexpected {word!r}")
            found.append(self.chain())
            self.blanks()
            self.comment()
            if self.looking(";;") or self.looking(";&"):
                continue
            if self.peek() in (";", "&") and self.peek():
                self.at += 1
            elif self.peek() not in ("", "\n", ")"):
                raise self.fail(f"unexpected {self.peek()!r}")

    def block(self, stops: tuple[str, ...]) -> list[Node]:
        found = self.statements(stops)
        if not found:
            raise self.fail("expected a command")
        return found

    def chain(self) -> Node:
        """Pipelines joined by ``&&`` and ``||``."""
        parts = [self.pipeline()]
        while True:
            self.blanks()
            if not (self.looking("&&") or self.looking("||")):
                return parts[0] if len(parts) == 1 else Node(inner=parts)
            self.at += 2
            self.lines()
            parts.append(self.pipeline())

    def pipeline(self) -> Node:
        self.blanks()
        while self.reserved() in ("!", "time"):
            self.at += len(self.reserved())
            self.blanks()
            while self.reserved() == "-p":
                self.at += 2
                self.blanks()
        begin = self.at
        parts = [self.command()]
        while True:
            self.blanks()
            if not self.looking("|") or self.looking("||"):
                break
            self.at += 2 if self.looking("|&") else 1
            self.lines()
            if self.reserved() == "!":
                self.at += 1
                self.blanks()
            parts.append(self.command())
            whole = Node(inner=[parts[0], parts[1]], pipe=Pipe(begin, self.at, [parts[0]], parts[1]))
            parts = [whole]
        return parts[0]

    def redirect(self, node: Node) -> bool:
        """Consume a redirection if there is one here."""
        at = self.at
        while self.peek().isdigit():
            self.at += 1
        if self.peek() == "{" and at == self.at:
            end = self.text.find("}", self.at)
            if end > 0 and self.text[self.at + 1 : end].isidentifier() and self.text[end + 1 : end + 2] in ("<", ">"):
                self.at = end + 1
        op = next((r for r in _REDIRECTS if self.looking(r)), None)
        if op is None or (op in "<>" and self.peek(1) == "(" and at == self.at):
            self.at = at
            return False
        self.at += len(op)
        self.blanks()
        begin = self.at
        value, _, inner = self.word()
        if self.at == begin:
            raise self.fail("redirection without a target")
        if op in ("<<", "<<-"):
            raw = self.text[begin : self.at]
            mark = raw.replace("\\", "").replace("'", "").replace('"', "")
            self.heredocs.append((mark, mark != raw, op == "<<-", node))
        else:
            node.inner += inner
        return True

    def command(self) -> Node:
        self.blanks()
        node = Node()
        word = self.reserved()
        if self.looking("((") and (end := self.arithmetic()) is not None:
            node.inner = _Parser(self.text[: end - 2], self.at + 2).expansions()
            self.at = end
        elif self.peek() == "(":
            self.at += 1
            node.inner = self.block((")",))
            if self.peek() != ")":
                raise self.fail("subshell without its end")
            self.at += 1
        elif word == "{":
            self.at += 1
            node.inner = self.block(("}",))
            self.expect("}")
        elif word == "if":
            self.at += 2
            node.inner = self.block(("then",))
            self.expect("then")
            while True:
                node.inner += self.block(("elif", "else", "fi"))
                word = self.reserved()
                self.at += len(word)
                if word == "elif":
                    node.inner += self.block(("then",))
                    self.expect("then")
                elif word == "else":
                    node.inner += self.block(("fi",))
                    self.expect("fi")
                    break
                elif word == "fi":
                    break
                else:
                    raise self.fail("expected 'fi'")
        elif word in ("while", "until"):
            self.at += len(word)
            node.inner = self.block(("do",))
            self.loop(node)
        elif word in ("for", "select"):
            self.at += len(word)
            self.blanks()
            if self.looking("((") and (end := self.arithmetic()) is not None:
                node.inner = _Parser(self.text[: end - 2], self.at + 2).expansions()
                self.at = end
            else:
                name = self.reserved()
                if not name.isidentifier():
                    raise self.fail("expected a name")
                self.at += len(name)
                self.lines()
                if self.reserved() == "in":
                    self.at += 2
                    self.blanks()
                    while self.peek() not in ("", "\n", ";", "#"):
                        begin = self.at
                        node.inner += self.word()[2]
                        if self.at == begin:
                            raise self.fail(f"unexpected {self.peek()!r}")
                        self.blanks()
                    self.comment()
            self.blanks()
            if self.peek() == ";":
                self.at += 1
            self.lines()
            if self.reserved() == "{":
                self.at += 1
                node.inner += self.block(("}",))
                self.expect("}")
            else:
                self.loop(node)
        elif word == "case":
            self.cases(node)
        elif word == "function" or self.function():
            if word == "function":
                self.at += len(word)
                self.blanks()
                self.at += len(self.reserved())
                self.blanks()
                if self.looking("("):
                    self.at = self.text.find(")", self.at) + 1
                    if not self.at:
                        raise self.fail("expected ')'")
            self.lines()
            node.inner = [self.command()]
        elif word == "[[":
            node.inner = self.test()
        elif word == "coproc":
            self.at += len(word)
            self.blanks()
            node.inner = [self.command()]
        elif word in CLOSERS:
            raise self.fail(f"unexpected {word!r}")
        else:
            return self.simple(node)
        self.blanks()
        while self.redirect(node):
            self.blanks()
        return node

    def loop(self, node: Node) -> None:
        self.expect("do")
        node.inner += self.block(("done",))
        self.expect("done")

    def function(self) -> bool:
        """At ``name ( )``: consumed up to the body."""
        end = self.at
        while end < len(self.text) and self.text[end] not in META and self.text[end] not in "\"'$`\\=":
            end += 1
        rest = end
        while rest < len(self.text) and self.text[rest] in " \t":
            rest += 1
        if end == self.at or not self.text.startswith("(", rest):
            return False
        shut = rest + 1
        while shut < len(self.text) and self.text[shut] in " \t":
            shut += 1
        if not self.text.startswith(")", shut):
            return False
        self.at = shut + 1
        return True

    def cases(self, node: Node) -> None:
        self.at += 4
        self.blanks()
        node.inner = self.word()[2]
        self.expect("in")
        while True:
            self.lines()
            if self.reserved() == "esac":
                self.at += 4
                return
            if self.peek() == "(":
                self.at += 1
            while True:
                self.blanks()
                begin = self.at
                node.inner += self.word()[2]
                if self.at == begin:
                    raise self.fail("expected a pattern")
                self.blanks()
                if self.peek() == "|":
                    self.at += 1
                    continue
                break
            if self.peek() != ")":
                raise self.fail("expected ')'")
            self.at += 1
            node.inner += self.statements((";;", "esac"))
            for end in (";;&", ";;", ";&"):
                if self.looking(end):
                    self.at += len(end)
                    break

    def test(self) -> list[Node]:
        self.at += 2
        inner: list[Node] = []
        while True:
            self.lines()
            if not self.peek():
                raise self.fail("'[[' without its end")
            if self.reserved() == "]]":
                self.at += 2
                return inner
            begin = self.at
            inner += self.word()[2]
            if self.at == begin:
                self.at += 1  # an operator or a bracket

    def simple(self, node: Node) -> Node:
        """Assignments, words and redirections in any order."""
        begin, end = self.at, self.at
        words: list[tuple[str, bool]] = []
        nested: list[Node] = []
        declaration = False
        some = False
        while True:
            self.blanks()
            c = self.peek()
            if not c or c in "\n;&|)" and not self.looking("&>"):
                break
            if c == "#" and (self.at == 0 or self.text[self.at - 1] in META):
                break
            if self.redirect(node):
                some, end = True, self.at
                continue
            if c == "(":
                raise self.fail("unexpected '('")
            name = self.assignment()
            if name and (not words or declaration):
                self.at += name
                some = True
                if self.peek() == "(":
                    nested += self.balanced("(", ")")
                else:
                    nested += self.word()[2]
            else:
                at = self.at
                value, dynamic, inner = self.word()
                if self.at == at:
                    raise self.fail(f"unexpected {c!r}")
                if not words and self.text[at : self.at] in DECLARATIONS:
                    declaration = True
                words.append((value, dynamic))
                nested += inner
            end = self.at
        if not words and not some:
            raise self.fail(f"unexpected {self.peek()!r}")
        if words and not declaration:
            node.call = Call(begin, end, words)
        node.inner = nested + node.inner
        return node

    def assignment(self) -> int:
        """Length of ``name=``, ``name+=`` or ``name[...]=`` here, else 0."""
        i = self.at
        if not (self.peek().isalpha() or self.peek() == "_"):
            return 0
        while i < len(self.text) and (self.text[i].isalnum() or self.text[i] == "_"):
            i += 1
        if self.text[i : i + 1] == "[":
            shut = self.text.find("]", i)
            if shut < 0:
                return 0
            i = shut + 1
        if self.text[i : i + 1] == "+":
            i += 1
        return i + 1 - self.at if self.text[i : i + 1] == "=" else 0


def parse(text: str) -> list[Node]:
    p = _Parser(text)
    found = p.statements(())
    p.lines()
    if p.at < len(text):
        raise p.fail(f"unexpected {p.peek()!r}")
    if p.heredocs:
        raise p.fail("here-document without its end")
    return found


def first_call(nodes: list[Node]) -> Call | None:
    return next((c for n in nodes for c in n.calls()), None)


def pipes_into_interpreter(program: str, downloaders: tuple[str, ...], interpreters: tuple[str, ...]) -> bool:
    """Whether a pipe of the program leads from a downloader to an interpreter, both named statically."""

    def name(call: Call | None) -> str:
        return call.words[0][0].rstrip("/").rpartition("/")[2] if call and not call.words[0][1] else ""

    try:
        nodes = parse(program)
    except (ShellSyntaxError, RecursionError):
        return False
    return any(name(first_call(p.left)) in downloaders and name(first_call([p.right])) in interpreters for n in nodes for p in n.pipes())
