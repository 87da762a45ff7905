"""Dictionary servers (RFC 2229) as a Spark data source with an exchangeable transport.

``spark.read.format("dict").option("servers", "host:port").option("words", "a,b").load()`` asks each database of
each server, one partition each. The transport is a function from (host, port) to a pair of functions, one that
sends a line and one that returns the next line; the default opens a socket. It is given as "module:function".
"""

from __future__ import annotations

import importlib
import re
import socket
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from glossmill.sources.registry import Format

TIMEOUT = 10
PRIORITY = 100
GROUP = "DICT Servers"
Transport = Callable[[str, int], tuple[Callable[[str], None], Callable[[], str]]]


def sockets(host: str, port: int) -> tuple[Callable[[str], None], Callable[[], str]]:
    link = socket.create_connection((host, port), TIMEOUT)
    stream = link.makefile("rwb")

    def send(line: str) -> None:
        stream.write(line.encode() + b"\r\n")
        stream.flush()

    def receive() -> str:
        line = stream.readline()
        if not line:
            raise ConnectionError(f"{host}:{port} closed the connection")
        return line.decode("utf-8", "replace").rstrip("\r\n")

    return send, receive


def sanitized(text: str) -> str:
    """Without line ends, quotes and backslashes escaped."""
    return re.sub(r"[\r\n]", "", re.sub(r'(["\\])', r"\\\1", text))


def parse_path(path: str) -> tuple[str, int, str] | None:
    m = re.fullmatch(r"dict://([^:]+):([0-9]+)/(.+)", path, re.DOTALL)
    return (m[1], int(m[2]), m[3]) if m else None


class Client:
    """One connection; the banner is read when it opens."""

    def __init__(self, host: str, port: int, transport: Transport = sockets):
        self.send, self.receive = transport(host, port)
        self._status()

    def _status(self) -> tuple[int, str]:
        while True:
            line = self.receive()
            if re.match(r"[0-9]{3} ", line):
                return int(line[:3]), line[4:]

    def _body(self) -> list[str]:
        out = []
        while (line := self.receive()) != ".":
            out.append(line[1:] if line.startswith("..") else line)
        return out

    def _listed(self, command: str, code: int) -> list[str]:
        self.send(command)
        status, _ = self._status()
        if status != code:
            return []
        out = self._body()
        self._status()
        return out

    def databases(self) -> list[tuple[str, str]]:
        rows = (re.fullmatch(r'(\S+)\s+"?(.*?)"?', line) for line in self._listed("SHOW DB", 110))
        return [(m[1], m[2]) for m in rows if m]

    def match(self, database: str, strategy: str, word: str) -> list[str]:
        rows = (re.fullmatch(r'\S+\s+"?(.*?)"?', line) for line in self._listed(f'MATCH {sanitized(database)} {strategy} "{sanitized(word)}"', 152))
        return [m[1] for m in rows if m]

    def define(self, database: str, word: str) -> list[str]:
        self.send(f'DEFINE {sanitized(database)} "{sanitized(word)}"')
        out = []
        while True:
            status, _ = self._status()
            if status == 151:
                out.append("\n".join(self._body()))
            elif status == 250 or status >= 400:
                return out


def discover(servers: list[str], enabled: bool = False, transport: Transport = sockets) -> list[dict]:
    """The databases of dictionary servers ("host:port") as dictionaries; none unless enabled. A server that can't be
    reached is left out."""
    out = []
    for server in servers if enabled else ():
        host, _, port = server.partition(":")
        try:
            found = Client(host, int(port or 2628), transport).databases()
        except (OSError, ValueError):
            continue
        for name, title in found:
            path = f"dict://{host}:{int(port or 2628)}/{name}"
            out.append({"path": path, "format_name": "dict-protocol", "name": title or name, "source_lang": "", "target_lang": "", "group": GROUP, "priority": PRIORITY, "skip_index": True})
    return out


class Pool:
    """Connections by server, kept and used again while they answer."""

    def __init__(self, connect: Transport = sockets):
        self.connect, self.open = connect, {}

    def transport(self, host: str, port: int):
        """For clients that are made elsewhere: a server's connection as it is, without a second banner."""
        client = self.client(host, port)
        waiting = ["220 connected"]
        return client.send, lambda: waiting.pop() if waiting else client.receive()

    def client(self, host: str, port: int) -> Client:
        if (host, port) not in self.open:
            self.open[host, port] = Client(host, port, self.connect)
        return self.open[host, port]

    def drop(self, host: str, port: int) -> None:
        """Forgets a connection that doesn't answer."""
        self.open.pop((host, port), None)


class DictServer(Format):
    """Dictionary servers as a format without files: they list their dictionaries and answer words themselves."""

    name = "dict-protocol"
    skip_index = True
    markup = "text"

    def __init__(self, servers: list[str] | None = None, enabled: bool = False, connect: Transport = sockets):
        self.servers, self.enabled, self.connect = servers or [], enabled, connect
        self.pool: Pool | None = None  # made where it is used

    def detect(self, path: str, head: bytes) -> bool:
        return parse_path(path) is not None

    def discover(self) -> list[dict]:
        return [{k: v for k, v in d.items() if k != "skip_index"} for d in discover(self.servers, self.enabled, self.connect)]

    def query_exact(self, path: str, word: str) -> Iterator[tuple[str, str]]:
        host, port, database = parse_path(path)
        self.pool = self.pool or Pool(self.connect)
        try:
            found = self.pool.client(host, port).define(database, word)
        except OSError:
            self.pool.drop(host, port)
            raise
        return ((f"{word}:{n}", body) for n, body in enumerate(found))


class _Database(InputPartition):
    def __init__(self, host: str, port: int, name: str, title: str):
        self.host, self.port, self.name, self.title = host, port, name, title


class DictReader(DataSourceReader):
    def __init__(self, options):
        self.servers = [s.strip() for s in options.get("servers", "").split(",") if s.strip()]
        self.words = [w for w in options.get("words", "").split(",") if w]
        module, _, name = options.get("transport", f"{__name__}:sockets").partition(":")
        self.transport = getattr(importlib.import_module(module), name)

    def partitions(self) -> list[InputPartition]:
        out = []
        for server in self.servers:
            host, _, port = server.partition(":")
            client = Client(host, int(port or 2628), self.transport)
            out += [_Database(host, int(port or 2628), name, title) for name, title in client.databases()]
        return out

    def read(self, partition: _Database) -> Iterator[tuple]:
        client = Client(partition.host, partition.port, self.transport)
        path = f"dict://{partition.host}:{partition.port}/{partition.name}"
        for word in self.words:
            for n, body in enumerate(client.define(partition.name, word)):
                yield path, partition.title, word, f"{word}:{n}", body


class DictSource(DataSource):
    """Entries have a key, "WORD:N", instead of an extent."""

    @classmethod
    def name(cls) -> str:
        return "dict"

    def schema(self) -> str:
        return "path string, name string, headword string, entry_key string, body string"

    def reader(self, schema) -> DictReader:
        return DictReader(self.options)
