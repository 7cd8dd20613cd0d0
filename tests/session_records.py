"""Builders of log records, and rows of frames, for the session tests."""

SF = "/root/testdata/sf0.001"


def asst(text="", calls=(), request=None, effort=None, tokens=100, model="m", **more):
    content = ([{"type": "text", "text": text}] if text else []) + [{"type": "tool_use", "id": i, "name": n, "input": p} for i, n, p in calls]
    usage = {"input_tokens": tokens, "output_tokens": 5}
    rec = {"type": "assistant", "requestId": request, "timestamp": "2024-05-01T10:00:00Z", "message": {"role": "assistant", "model": model, "content": content, "usage": usage}}
    return rec | ({"effort": effort} if effort else {}) | more


def human(text, **more):
    return {"type": "user", "timestamp": "2024-05-01T10:00:00Z", "message": {"role": "user", "content": text}} | more


def result(call, text, error=False, **more):
    block = {"type": "tool_result", "tool_use_id": call, "content": text} | ({"is_error": True} if error else {})
    return {"type": "user", "message": {"role": "user", "content": [block]}} | more


def rows(df, *order):
    out = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(out, key=lambda r: tuple(str(r[o]) if not isinstance(r[o], int) else r[o] for o in order)) if order else out
