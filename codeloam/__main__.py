"""``python -m codeloam``."""

from codeloam.api import main

main()
