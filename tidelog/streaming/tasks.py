"""A background task on the driver: asked when to run, woken early, stopped with its error."""

from __future__ import annotations

import threading
from collections.abc import Callable


class BackgroundTask:
    """Calls should_run again and again; it answers True, or the seconds after which to ask again; True runs run().

    None and False ask again only when check_should_run() says so, 0 at once.

    The first error ends the task and stop() raises it. stop() waits for the end.
    """

    def __init__(self, should_run: Callable[[], bool | float], run: Callable[[], None]):
        self._should_run, self._run = should_run, run
        self._wake, self._stop, self._error = threading.Event(), threading.Event(), None
        self._thread = threading.Thread(target=self._loop, daemon=True)
        self._thread.start()

    def _loop(self) -> None:
        try:
            while not self._stop.is_set():
                answer = self._should_run()
                if answer is True:
                    self._run()
                else:
                    self._wake.wait(None if answer is None or answer is False else answer)
                    self._wake.clear()
        except BaseException as e:  # noqa: BLE001
            self._error = e

    def check_should_run(self) -> None:
        """Asks again now."""
        self._wake.set()

    @property
    def failed(self) -> bool:
        return self._error is not None

    def join(self, seconds: float) -> None:
        """Waits for the task's end, but no longer than that."""
        self._thread.join(seconds)

    def stop(self) -> None:
        self._stop.set()
        self._wake.set()
        self._thread.join()
        if self._error:
            raise self._error
