"""A streaming source that listens for syslog messages on TCP, UDP or both, and spools them in a shared folder.

spark.dataSource.register(SyslogSource)
spark.readStream.format("syslog").option("port", "5514").option("spool", "/shared/syslog").load()

Sockets can't be read twice, so what arrives is appended to spool files first; offsets are bytes of these files, as in
``tail``.  The driver listens and only looks at sizes; executors read the files.  A batch that fails is read again, and
files that are read to their end go once their batch is committed.  Hosts that send very much are better served by a
relay that writes files for ``tail``.
"""

from __future__ import annotations

import json
import os
import socketserver
import ssl
import threading
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, InputPartition

from .tail import TailReader

SCHEMA = "source_ip string, message string"
#: Largest datagram, and bytes after which another spool file is begun.
DATAGRAM, SPOOL_BYTES = 65536, 64 << 20


class SyslogSource(DataSource):
    """Options: spool (a folder that driver and executors share), protocol (``udp``, the default, ``tcp`` or ``both``),
    host (default all addresses), port, cert and key (files; TCP then takes TLS from 1.2 on)."""

    @classmethod
    def name(cls) -> str:
        return "syslog"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> SyslogReader:  # noqa: N802  the API's name
        return SyslogReader(self.options)


class Spool:
    """Appends messages to files of a folder, one JSON line each."""

    def __init__(self, folder: str, most: int = SPOOL_BYTES):
        self.folder, self.most, self.lock, self.file = folder, most, threading.Lock(), None
        os.makedirs(folder, exist_ok=True)

    def add(self, address: str, message: bytes) -> None:
        line = json.dumps([address, message.decode("utf-8", "replace")]) + "\n"
        with self.lock:
            if self.file is None or self.file.tell() >= self.most:
                if self.file is not None:
                    self.file.close()
                self.file = open(os.path.join(self.folder, f"{time.time_ns():020d}.spool"), "ab")  # noqa: SIM115
            self.file.write(line.encode())
            self.file.flush()

    @property
    def current(self) -> str | None:
        with self.lock:
            return None if self.file is None else self.file.name


def listeners(spool: Spool, host: str, port: int, protocol: str, cert: str | None = None, key: str | None = None) -> list[socketserver.BaseServer]:
    """Servers on threads of their own that put each line (TCP) or datagram (UDP) into the spool."""
    largest = DATAGRAM  # pickling by value overlooks globals of class bodies

    class Lines(socketserver.StreamRequestHandler):
        def handle(self) -> None:
            for line in self.rfile:
                spool.add(self.client_address[0], line.rstrip(b"\r\n"))

    class Datagram(socketserver.BaseRequestHandler):
        def handle(self) -> None:
            spool.add(self.client_address[0], self.request[0])

    class Tcp(socketserver.ThreadingTCPServer):
        allow_reuse_address, daemon_threads = True, True

        def get_request(self):
            connection, address = super().get_request()
            if cert:
                context = ssl.SSLContext(ssl.PROTOCOL_TLS_SERVER)
                context.minimum_version = ssl.TLSVersion.TLSv1_2
                context.load_cert_chain(cert, key)
                connection = context.wrap_socket(connection, server_side=True, do_handshake_on_connect=False)
            return connection, address

    class Udp(socketserver.UDPServer):
        allow_reuse_address, max_packet_size = True, largest

    wanted = {"tcp": [(Tcp, Lines)], "udp": [(Udp, Datagram)], "both": [(Tcp, Lines), (Udp, Datagram)]}
    if protocol not in wanted:
        raise ValueError(f"protocol is tcp, udp or both, not {protocol!r}")
    servers = [server((host, port), handler) for server, handler in wanted[protocol]]
    for server in servers:
        threading.Thread(target=server.serve_forever, daemon=True).start()
    return servers


class SyslogReader(TailReader):
    """Offsets and pieces are those of the spool files; listening begins with the query."""

    def __init__(self, options: dict):
        super().__init__({"paths": os.path.join(options["spool"], "*.spool"), "from": "start"})
        self.given = dict(options)
        self.spool: Spool | None = None
        self.servers: list[socketserver.BaseServer] = []

    def listen(self) -> None:
        if self.spool is None:
            self.spool = Spool(self.given["spool"])
            o = self.given
            self.servers = listeners(self.spool, o.get("host", ""), int(o["port"]), o.get("protocol", "udp"), o.get("cert"), o.get("key"))

    def initialOffset(self) -> dict:  # noqa: N802
        self.listen()
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        self.listen()
        return super().latestOffset()

    def commit(self, end: dict) -> None:
        for path, (_, to) in end.items():
            if self.spool is not None and path != self.spool.current and os.path.exists(path) and os.path.getsize(path) == to:
                os.remove(path)

    def stop(self) -> None:
        for server in self.servers:
            server.shutdown()
            server.server_close()

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for _, _, line in super().read(partition):
            yield tuple(json.loads(line))
