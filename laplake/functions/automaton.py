"""Many words looked for in a text at once."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable


class WordAutomaton:
    """Aho-Corasick automaton whose words carry keys: a text's answer is the least key of the words in it.

    Every state knows the least key of all words that end there, its own and those of its
    failure states, so a text is read once, letter by letter, whatever the number of words.
    """

    def __init__(self, words: Iterable[tuple[str, tuple]]):
        self.steps: list[dict[str, int]] = [{}]
        self.best: list[tuple | None] = [None]
        for word, key in words:
            if word:
                state = self._path(word)
                self.best[state] = key if self.best[state] is None else min(self.best[state], key)
        self.back = [0] * len(self.steps)
        waiting = deque(self.steps[0].values())
        while waiting:
            state = waiting.popleft()
            for letter, child in self.steps[state].items():
                self.back[child] = self._next(self.back[state], letter)
                waiting.append(child)
            behind = self.best[self.back[state]]
            if behind is not None:
                self.best[state] = behind if self.best[state] is None else min(self.best[state], behind)

    def _path(self, word: str) -> int:
        state = 0
        for letter in word:
            if letter not in self.steps[state]:
                self.steps[state][letter] = len(self.steps)
                self.steps.append({})
                self.best.append(None)
            state = self.steps[state][letter]
        return state

    def _next(self, state: int, letter: str) -> int:
        while state and letter not in self.steps[state]:
            state = self.back[state]
        return self.steps[state].get(letter, 0)

    def least(self, text: str) -> tuple | None:
        """The least key of all words that occur in the text; None without any."""
        state, found = 0, None
        for letter in text:
            state = self._next(state, letter)
            if (here := self.best[state]) is not None and (found is None or here < found):
                found = here
        return found
