"""Byte files in the shared folder, by whatever file system its URI names."""

from __future__ import annotations

import os

import pyarrow.fs as fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    system, path = _at(uri)
    system.create_dir(path, recursive=True)


def create(uri: str):
    system, path = _at(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path, compression=None)


def open_file(uri: str):
    system, path = _at(uri)
    return system.open_input_file(path)


def read(uri: str) -> bytes:
    with open_file(uri) as f:
        return f.read()
