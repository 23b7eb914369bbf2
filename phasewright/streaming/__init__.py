"""Extensions to unbounded input; the batch operators need none of this."""
