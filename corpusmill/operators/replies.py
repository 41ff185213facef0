"""Replies of a client, stored by the digest of what it was asked: a task that is lost and done again doesn't ask again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from corpusmill.operators.agent import parse_json
from corpusmill.sources.put_once import Folder


def digest(task: str, payload: dict) -> str:
    return hashlib.sha256(json.dumps([task, payload], sort_keys=True, ensure_ascii=False, default=str).encode("utf-8", "surrogatepass")).hexdigest()


class Recorded:
    """``client`` with a memory in ``folder``, which all executors see.

    A readable reply is stored before it is used, under the digest of task, payload and ``version`` (what else the reply depends
    on: model, temperature).  Failures and unreadable replies aren't stored, so another attempt asks again.  Two copies of a task
    that run at once may both ask; both then use what was stored first.
    """

    def __init__(self, client: Callable[[str, dict], object], folder: str, version: str = "1"):
        self.client, self.folder, self.version = client, Folder(folder), version

    def __call__(self, task: str, payload: dict) -> object:
        key = digest(f"{self.version}:{task}", payload)
        name = f"{key[:2]}/{key}.json"
        known = self.folder.get(name)
        if known is None:
            reply = self.client(task, payload)
            found = reply if isinstance(reply, dict) else parse_json(str(reply))
            if found is None:
                return reply
            self.folder.put(name, json.dumps(found, ensure_ascii=False).encode("utf-8", "surrogatepass"))
            known = self.folder.get(name)
        return json.loads(known)
