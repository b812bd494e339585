"""A short notation of trees for tests."""


def show(node) -> str:
    if node.kind == "text":
        return repr(node.data)
    if node.kind == "comment":
        return f"<!--{node.data}-->"
    if node.kind == "doctype":
        return f"!{node.tag}"
    attrs = "".join(f" {k}={v}" for k, v in (node.attrs or {}).items())
    return f"{node.tag or '#'}{attrs}({', '.join(map(show, node.children))})"


def body(document) -> str:
    html = next(c for c in document.children if c.kind == "element")
    return ", ".join(show(c) for c in html.children[-1].children)
