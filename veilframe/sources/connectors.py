"""Connectors: mail over IMAP and files of a cloud drive, as Python data sources.

    spark.dataSource.register(connectors.MailSource)
    spark.read.format("imap").options(server=..., user=..., password=..., days="7", sender=..., subject=...).load()

Each message is a row; folders are read in parallel. Filters go to the server where it can apply them.
"""

from __future__ import annotations

import datetime
import email
import email.policy
import imaplib
from collections.abc import Iterator
from email.message import EmailMessage

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAIL = "folder string, number string, subject string, sender string, date string, text string, attachments array<struct<path: string, content: binary>>"
FILES = "path string, content binary"


def message_row(folder: str, number: str, raw: bytes, types: tuple[str, ...] = ()) -> tuple:
    """A row of MAIL: the plain text body, and the attachments of the wanted extensions."""
    m: EmailMessage = email.message_from_bytes(raw, policy=email.policy.default)  # type: ignore[assignment]
    body = m.get_body(("plain",))
    files = [(p.get_filename(), p.get_payload(decode=True) or b"") for p in m.iter_attachments() if p.get_filename()]
    if types:
        files = [f for f in files if f[0].lower().endswith(tuple(t.lower() for t in types))]
    try:
        date = m["date"].datetime.isoformat() if m["date"] else None
    except (AttributeError, ValueError):
        date = None
    return folder, number, str(m["subject"] or ""), str(m["from"] or ""), date, body.get_content() if body else "", files


def criteria(options: dict[str, str], today: datetime.date) -> list[str]:
    """Search keys for the server."""
    since = today - datetime.timedelta(days=int(options.get("days", "7")))
    out = [f'SINCE "{since.strftime("%d-%b-%Y")}"']
    for key, name in (("sender", "FROM"), ("subject", "SUBJECT")):
        if options.get(key):
            out.append(f'{name} "{options[key].replace(chr(34), "")}"')
    return out


class _Folder(InputPartition):
    pass


class _MailReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [_Folder(f.strip()) for f in self.options.get("folder", "INBOX").split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        types = tuple(t.strip() for t in self.options.get("file_types", "").split(",") if t.strip())
        with imaplib.IMAP4_SSL(self.options["server"]) as server:
            server.login(self.options["user"], self.options["password"])
            server.select(partition.value, readonly=True)
            _, found = server.search(None, *criteria(self.options, datetime.date.today()))
            for number in found[0].split():
                _, data = server.fetch(number, "(RFC822)")
                yield message_row(partition.value, number.decode(), data[0][1], types)


class MailSource(DataSource):
    """Messages of IMAP folders. Options: server, user, password, folder (comma-separated), days, sender, subject, file_types."""

    @classmethod
    def name(cls) -> str:
        return "imap"

    def schema(self) -> str:
        return MAIL

    def reader(self, schema) -> DataSourceReader:
        return _MailReader(self.options)


class _DriveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def _service(self):
        try:
            from google.oauth2.service_account import Credentials
            from googleapiclient.discovery import build
        except ImportError as e:
            raise RuntimeError("the drive source needs google-api-python-client") from e
        scopes = ["https://www.googleapis.com/auth/drive.readonly"]
        return build("drive", "v3", credentials=Credentials.from_service_account_file(self.options["credentials"], scopes=scopes))

    def partitions(self) -> list[InputPartition]:
        """One for each file, so that files are downloaded in parallel."""
        wanted = [t.strip() for t in self.options.get("file_types", "").split(",") if t.strip()]
        where = [f"'{self.options['folder']}' in parents"] if self.options.get("folder") else []
        where += [f"({' or '.join(f"name contains '.{t.lstrip('.')}'" for t in wanted)})"] if wanted else []
        out, token = [], None
        while True:
            page = self._service().files().list(q=" and ".join(where) or None, fields="nextPageToken, files(id, name)", pageToken=token).execute()
            out += [_Folder((f["id"], f["name"])) for f in page["files"]]
            if not (token := page.get("nextPageToken")):
                return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        number, name = partition.value
        yield name, self._service().files().get_media(fileId=number).execute()


class DriveSource(DataSource):
    """Files of a drive as (path, content), as readers.documents takes them. Options: credentials, folder, file_types."""

    @classmethod
    def name(cls) -> str:
        return "drive"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return _DriveReader(self.options)
