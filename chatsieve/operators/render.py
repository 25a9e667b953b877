"""Conversations as training text."""

from __future__ import annotations

from dataclasses import dataclass

from chatsieve.functions.text import quoted

# Fixed value: one message in ChatML form.
CHATML = "<|im_start|>{role}\n{content}<|im_end|>\n"


@dataclass(frozen=True)
class Piece:
    """Text that a message contributes, with ``{role}``, ``{content}`` and ``{system}``.

    It is written for messages of ``roles`` (any, if empty) that stand ``at`` the first or last
    place, or not there; ``merged`` asks for a merged system message, or for none.
    """

    text: str
    roles: tuple[str, ...] = ()
    at: str = "any"
    merged: bool | None = None


@dataclass(frozen=True)
class ChatTemplate:
    """``head``, then the pieces of each message in turn, then ``tail``.

    With ``merge_system`` a system message at the start is no message of its own: its content is
    ``{system}`` in the pieces, and places count from the next message.
    """

    pieces: tuple[Piece, ...]
    head: str = ""
    tail: str = ""
    merge_system: bool = False


# Forms of well-known chat templates.
INST = ChatTemplate(
    (
        Piece("<s>[INST] <<SYS>>\n{system}\n<</SYS>>\n\n{content} [/INST]", ("user",), "first", True),
        Piece("<s>[INST] {content} [/INST]", ("user",), "first", False),
        Piece("<s>[INST] {content} [/INST]", ("user",), "not first"),
        Piece(" {content} </s>", ("assistant",)),
    ),
    merge_system=True,
)
ALPACA = ChatTemplate(
    (
        Piece("{system}\n\n", at="first", merged=True),
        Piece("### Instruction:\n{content}", ("user",)),
        Piece("### Response:\n{content}", ("assistant",)),
        Piece("### Note:\n{content}", ("system",)),
        Piece("\n\n", at="not last"),
        Piece("</s>", at="last"),
    ),
    merge_system=True,
)

_PLACES = {
    "first": "i = 0",
    "not first": "i > 0",
    "last": "i = size(said_) - 1",
    "not last": "i < size(said_) - 1",
}


def _filled(text: str) -> str:
    """SQL of a text with its fields filled in; a field value is not looked into."""
    fields = {"{role}": "m.role", "{content}": "m.content", "{system}": "system_"}
    parts, rest = [], text
    while rest:
        at, name = min(((rest.find(f), f) for f in fields if f in rest), default=(len(rest), ""))
        parts += [quoted(rest[:at])] if at else []
        parts += [fields[name]] if name else []
        rest = rest[at + len(name) :]
    return f"concat({', '.join(parts)})" if parts else "''"


def _piece(piece: Piece) -> str:
    conditions = []
    if piece.roles:
        conditions.append(f"m.role IN ({', '.join(map(quoted, piece.roles))})")
    if piece.at != "any":
        conditions.append(_PLACES[piece.at])
    if piece.merged is not None:
        conditions.append(f"system_ IS {'NOT ' if piece.merged else ''}NULL")
    filled = _filled(piece.text)
    return f"IF({' AND '.join(conditions)}, {filled}, '')" if conditions else filled


def render_message(role: str, content: str, template: str = CHATML) -> str:
    """One message through a template with ``{role}`` and then ``{content}``."""
    before, rest = template.split("{role}")
    between, after = rest.split("{content}")
    return (
        f"concat({quoted(before)}, {role}, {quoted(between)}, {content}, "
        f"{quoted(after)})"
    )


def render_chat(messages: str, template: str | ChatTemplate = CHATML) -> str:
    """All messages of a nested row as one text, no generation prompt."""
    if isinstance(template, str):
        message = render_message("m.role", "m.content", template)
        return f"array_join(transform({messages}, m -> {message}), '')"
    for piece in template.pieces:
        if "{system}" in piece.text and piece.merged is not True:
            raise ValueError("{system} needs a piece for merged system messages")
    system, said = "CAST(NULL AS STRING)", "all_"
    if template.merge_system:
        leads = "get(all_, 0).role <=> 'system'"
        system = f"IF({leads}, get(all_, 0).content, NULL)"
        said = f"IF({leads}, slice(all_, 2, size(all_) - 1), all_)"
    text = f"concat({', '.join(map(_piece, template.pieces)) or quoted('')})"
    body = f"array_join(transform(said_, (m, i) -> {text}), '')"
    whole = f"concat({quoted(template.head)}, {body}, {quoted(template.tail)})"
    inner = f"transform(array({said}), said_ -> {whole})[0]"
    outer = f"transform(array({system}), system_ -> {inner})[0]"
    rendered = f"transform(array({messages}), all_ -> {outer})[0]"
    return f"IF({messages} IS NULL, NULL, {rendered})"
