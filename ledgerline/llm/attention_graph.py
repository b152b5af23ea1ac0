"""The attention model of ``lm_scoring`` as onnxruntime graphs: class scores and gradients of windows.

The graphs compute what ``AttentionModel`` does in numpy, with the same
parameters, on one thread; numpy is used where onnxruntime is not installed.  A
graph is written here as its protocol buffer, field by field, since the library
only reads them.
"""

from __future__ import annotations

import numpy as np

try:
    import onnxruntime
except ImportError:  # numpy does the same
    onnxruntime = None

#: Windows at once, so that a batch's logits stay in the cache.
AT_ONCE = 32

_KINDS = {np.dtype(np.float32): 1, np.dtype(np.int64): 7}
_FUSED = "com.microsoft"


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(number: int, n: int) -> bytes:
    return _varint(number << 3) + _varint(n)


def _block(number: int, content: bytes | str) -> bytes:
    content = content.encode() if isinstance(content, str) else content
    return _varint(number << 3 | 2) + _varint(len(content)) + content


def _node(op: str, inputs: str, output: str, domain: str = "", **attributes: int | str) -> bytes:
    kinds = [(name, _number(3, x) + _number(20, 2) if isinstance(x, int) else _block(4, x) + _number(20, 3)) for name, x in attributes.items()]
    more = [_block(5, _block(1, name) + value) for name, value in kinds]
    return _block(1, b"".join([*(_block(1, i) for i in inputs.split()), _block(2, output), _block(4, op), *more, _block(7, domain)]))


def _value(number: int, name: str, kind: int, shape: tuple) -> bytes:
    dims = b"".join(_block(1, _number(1, d) if isinstance(d, int) else _block(2, d)) for d in shape)
    return _block(number, _block(1, name) + _block(2, _block(1, _number(1, kind) + _block(2, dims))))


def _constant(name: str, a: np.ndarray) -> bytes:
    dims = b"".join(_number(1, d) for d in a.shape)
    return _block(5, dims + _number(2, _KINDS[a.dtype]) + _block(8, name) + _block(9, np.ascontiguousarray(a).tobytes()))


def _session(nodes: list[bytes], inputs: dict[str, tuple], outputs: list[str], constants: dict[str, np.ndarray]):
    graph = b"".join([
        *nodes, _block(2, "attention"), *(_constant(k, v) for k, v in constants.items()),
        *(_value(11, name, kind, shape) for name, (kind, shape) in inputs.items()), *(_block(12, _block(1, name)) for name in outputs),
    ])
    versions = [_block(8, _block(1, domain) + _number(2, n)) for domain, n in (("", 17), (_FUSED, 1))]
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    options.log_severity_level = 3
    return onnxruntime.InferenceSession(_number(1, 8) + b"".join(versions) + _block(7, graph), options, providers=["CPUExecutionProvider"])


def _weights(model) -> dict[str, np.ndarray]:
    p = model.p
    q = p["x"] @ (p["q"] / np.float32(np.sqrt(p["x"].shape[1])))
    return {"Q": q, "K": p["x"] @ p["k"], "V": p["x"] @ p["v"], "bias": model._bias(), "oh": p["oh"], "xh": p["xh"], "hc": p["hc"], "c": p["c"]}


_FORWARD = [
    _node("Gather", "Q late", "q"), _node("Gather", "K rows", "k"), _node("Gather", "V rows", "v"),
    _node("FusedMatMul", "q k", "s", _FUSED, transB=1), _node("Add", "s bias", "biased"), _node("Softmax", "biased", "a", axis=2),
    _node("MatMul", "a v", "o"), _node("MatMul", "o oh", "oo"), _node("Gather", "xh late", "x"), _node("Add", "oo x", "pre"), _node("Tanh", "pre", "h"),
    _node("Reshape", "h by_hidden", "h2"), _node("Gemm", "h2 hc c", "logits"),
]

_BACKWARD = [
    _node("Softmax", "logits", "p", axis=1), _node("GatherElements", "p goals", "of", axis=1), _node("Sub", "of one", "less"),
    _node("ScatterElements", "p goals less", "d", axis=1), _node("Reshape", "o by_width", "o2"), _node("Mul", "h2 weight", "hw"),
    _node("Gemm", "hw d", "hc.g", transA=1), _node("Gemm", "weight d", "c.s", transA=1), _node("Reshape", "c.s minus", "c.g"), _node("Gemm", "d hc", "dh", transB=1),
    _node("Mul", "hw h2", "hh"), _node("Sub", "weight hh", "slope"), _node("Mul", "dh slope", "dpre"), _node("Gemm", "o2 dpre", "oh.g", transA=1),
    _node("Gemm", "dpre oh", "do2", transB=1), _node("Reshape", "do2 by_query", "do"), _node("FusedMatMul", "a do", "dv", _FUSED, transA=1),
    _node("FusedMatMul", "do v", "da", _FUSED, transB=1), _node("Mul", "do o", "doo"), _node("ReduceSum", "doo last", "mean", keepdims=1),
    _node("Sub", "da mean", "centred"), _node("Mul", "a centred", "ds"), _node("ReduceSum", "ds first", "bias.g", keepdims=0),
    _node("MatMul", "ds k", "dq"), _node("FusedMatMul", "ds q", "dk", _FUSED, transA=1), _node("Reshape", "dpre by_query_hidden", "dx"),
    _node("Unsqueeze", "late minus", "at_late"), _node("Unsqueeze", "rows minus", "at_rows"),
    *(_node("ScatterND", f"{name}.s {at} {values}", f"{name}.g", reduction="add") for name, at, values in (
        ("Q", "at_late", "dq"), ("K", "at_rows", "dk"), ("V", "at_rows", "dv"), ("xh", "at_late", "dx"))),
]


class Scorer:
    """Log probability of the class of each target of windows, for a model that stays as it is."""

    def __init__(self, model):
        window, stride = model.far.shape[1], model.far.shape[0]
        nodes = [*_FORWARD, _node("LogSoftmax", "logits", "all", axis=1), _node("GatherElements", "all goals", "own", axis=1)]
        inputs = {"rows": (7, ("n", window)), "late": (7, ("n", stride)), "goals": (7, ("m", 1))}
        self.session = _session(nodes, inputs, ["own"], _weights(model) | {"by_hidden": np.array([-1, len(model.p["hc"])])})
        self.late = window - stride

    def __call__(self, rows: np.ndarray, goals: np.ndarray) -> np.ndarray:
        feed = {"rows": rows, "late": np.ascontiguousarray(rows[:, self.late :]), "goals": goals.reshape(-1, 1)}
        return self.session.run(["own"], feed)[0].reshape(goals.shape)


class Gradients:
    """Gradients of a model's mean class loss, as ``AttentionModel.step`` has them."""

    rows = ("Q", "K", "V", "xh")  # summed by row, on from what the windows before gave
    whole = ("bias", "oh", "hc", "c")

    def __init__(self, model):
        self.model = model
        (stride, window), p = model.far.shape, model.p
        width, hidden = p["oh"].shape
        shapes = {"rows": (7, ("n", window)), "late": (7, ("n", stride)), "goals": (7, ("m", 1)), "weight": (1, ("m", 1))}
        shapes |= {name: (1, value.shape) for name, value in _weights(model).items()}
        self.zeros = {f"{name}.s": np.zeros((len(p["x"]), hidden if name == "xh" else width), np.float32) for name in self.rows}
        shapes |= {name: (1, value.shape) for name, value in self.zeros.items()}
        constants = {
            "by_hidden": np.array([-1, hidden]), "by_width": np.array([-1, width]), "by_query": np.array([-1, stride, width]),
            "by_query_hidden": np.array([-1, stride, hidden]), "first": np.array([0]), "last": np.array([2]), "minus": np.array([-1]), "one": np.ones(1, np.float32),
        }
        self.names = [f"{name}.g" for name in self.rows + self.whole]
        self.session = _session([*_FORWARD, *_BACKWARD], shapes, self.names, constants)
        self.seen = model.far >= 0

    def __call__(self, windows: np.ndarray) -> dict[str, np.ndarray]:
        model, p = self.model, self.model.p
        stride, window = model.far.shape
        ids = windows[:, :window]
        rows = model.slot[np.where(ids < 0, len(model.slot) - 1, ids)]
        late = np.ascontiguousarray(rows[:, window - stride :])
        targets = windows[:, window - stride + 1 :]
        real = targets >= 0
        weight = (real / np.float32(max(1, int(real.sum())))).astype(np.float32)
        goals = model.group[np.maximum(targets, 0)]
        feed, whole = _weights(model) | self.zeros, []
        for low in range(0, len(rows), AT_ONCE):
            at = slice(low, low + AT_ONCE)
            got = self.session.run(self.names, feed | {"rows": rows[at], "late": late[at], "goals": goals[at].reshape(-1, 1), "weight": weight[at].reshape(-1, 1)})
            feed |= dict(zip(self.zeros, got, strict=False))
            whole.append(got[len(self.rows) :])
        q, k, v, xh = (feed[name] for name in self.zeros)
        bias, oh, hc, c = (np.sum(x, 0) for x in zip(*whole, strict=True))
        q /= np.float32(np.sqrt(p["x"].shape[1]))
        return {
            "x": q @ p["q"].T + k @ p["k"].T + v @ p["v"].T, "q": p["x"].T @ q, "k": p["x"].T @ k, "v": p["x"].T @ v, "xh": xh,
            "near": np.bincount(model.far[self.seen], bias[self.seen], window).astype(np.float32), "oh": oh, "hc": hc, "c": c,
        }
