"""Field paths of known record families that redaction treats apart."""

from __future__ import annotations

# Paths whose values (``.*``: whose keys) may look random and stay, by family; the star is for all.
EXEMPT: dict[str, tuple[str, ...]] = {
    "claude-code": (
        "uuid", "parentUuid", "logicalParentUuid", "sessionId", "agentId", "message.id", "requestId", "promptId", "interruptedMessageId", "slug",
        "message.content[].id", "message.content[].tool_use_id", "toolUseResult.tool_use_id", "toolUseResult.results[].tool_use_id", "toolUseId",
        "sourceToolUseID", "attachment.toolUseID", "cwd", "wireToolInputs.*", "wireIngestContext.*", "shapeHash", "hash", "requestDigest", "tail[]",
    ),
    "codex": (
        "payload.call_id", "payload.response_id", "payload.item.changes.*",
    ),
    "cursor": (
        "composerId", "bubbleId", "checkpointId", "requestId", "content[].image.hex",
    ),
    "copilot": (
        "id", "parentId", "data.toolCallId", "data.toolRequests[].toolCallId", "data.parentToolCallId", "data.permissionRequest.toolCallId",
        "data.promptRequest.toolCallId", "data.apiCallId", "data.message.apiCallId", "data.messages[].apiCallId", "data.modelCall.api_id",
        "data.responseChunk.id", "data.toolTelemetry.properties.hashedUrl", "data.context.cwd", "data.encryptedContent", "data.reasoningOpaque",
        "data.reasoningBlocks.blocks[].encrypted_content", "data.reasoningBlocks.blocks[].id", "v.requests[].requestId", "v[].requestId",
        "v.requests[].responseId", "v[].responseId", "v.requests[].response[].id", "v[].response[].id", "v[].id",
        "v.requests[].response[].toolCallId", "v[].response[].toolCallId", "v[].toolCallId", "v.metadata.toolCallRounds[].toolCalls[].id",
        "v.metadata.toolCallRounds[].thinking.id", "v.metadata.toolCallRounds[].thinking.encrypted", "v.metadata.toolCallRounds[].statefulMarker",
        "v[].result.metadata.toolCallRounds[].toolCalls[].id", "v[].result.metadata.toolCallRounds[].thinking.id",
        "v[].result.metadata.toolCallRounds[].thinking.encrypted", "v[].result.metadata.toolCallRounds[].statefulMarker",
        "v.requests[].result.metadata.toolCallRounds[].toolCalls[].id", "v.requests[].result.metadata.toolCallRounds[].thinking.id",
        "v.requests[].result.metadata.toolCallRounds[].thinking.encrypted", "v.requests[].result.metadata.toolCallRounds[].statefulMarker",
        "v.metadata.toolCallResults.*", "v[].result.metadata.toolCallResults.*", "v.requests[].result.metadata.toolCallResults.*",
        "v[].invocationMessage.uris.*", "v[].pastTenseMessage.uris.*", "v[].response[].invocationMessage.uris.*",
        "v[].response[].pastTenseMessage.uris.*", "v.requests[].response[].invocationMessage.uris.*",
        "v.requests[].response[].pastTenseMessage.uris.*", "requests[].requestId", "requests[].responseId", "requests[].response[].id",
        "requests[].response[].toolCallId", "requests[].result.metadata.toolCallRounds[].toolCalls[].id",
        "requests[].result.metadata.toolCallRounds[].thinking.id", "requests[].result.metadata.toolCallRounds[].thinking.encrypted",
        "requests[].result.metadata.toolCallRounds[].statefulMarker", "requests[].result.metadata.toolCallResults.*",
        "requests[].response[].invocationMessage.uris.*", "requests[].response[].pastTenseMessage.uris.*",
    ),
    "pi": (
        "message.content[].id", "message.toolCallId",
    ),
    "opencode": (
        "id", "parent_id", "session_id", "message_id", "data.parentID", "data.callID", "fork_session_id", "data.content[].id",
    ),
    "hermes": (
        "tool_call_id", "tool_calls#json[].id", "tool_calls#json[].call_id", "tool_calls#json[].response_item_id",
    ),
    "*": (
        "timestamp", "version",
    ),
}

# Paths whose long values are ciphertext or media and go whole.
DROPS: dict[str, tuple[str, ...]] = {
    "claude-code": (
        "message.content[].signature", "message.content[].data", "message.content[].source.data", "message.content[].content[].source.data",
        "attachment.prompt[].source.data", "toolUseResult.file.base64",
    ),
    "codex": (
        "payload.encrypted_content", "payload.content[].encrypted_content", "payload.replacement_history[].encrypted_content",
        "payload.replacement_history[].content[].encrypted_content", "payload.guardian_history[].encrypted_content",
        "payload.guardian_history[].content[].encrypted_content", "payload.output[].encrypted_content",
        "payload.replacement_history[].output[].encrypted_content", "payload.guardian_history[].output[].encrypted_content",
        "payload.item.output[].encrypted_content", "payload.content[].image_url", "payload.output[].image_url",
        "payload.replacement_history[].content[].image_url", "payload.replacement_history[].output[].image_url",
        "payload.guardian_history[].content[].image_url", "payload.guardian_history[].output[].image_url", "payload.images[]",
        "payload.item.content[].image_url", "payload.item.result", "payload.item.result.content[].data",
        "payload.item.result._meta.codex/toolSurface.screenshot.url", "payload.result", "payload.result.Ok.content[].data",
        "payload.item.output[].image_url", "payload.content[].audio_url", "payload.output[].audio_url",
        "payload.replacement_history[].content[].audio_url", "payload.replacement_history[].output[].audio_url",
        "payload.guardian_history[].content[].audio_url", "payload.guardian_history[].output[].audio_url", "payload.item.content[].audio_url",
        "payload.item.output[].audio_url", "payload.item.content_items[].imageUrl", "payload.item.content_items[].audioUrl",
    ),
    "pi": (
        "message.content[].thinkingSignature", "message.content[].data",
    ),
    "opencode": (
        "data.content[].state.reasoningEncryptedContent",
    ),
}


def exempt_for(family: str) -> tuple[str, ...]:
    """The exempt paths of a family, and those of all."""
    return (*EXEMPT.get(family, ()), *EXEMPT["*"])


def drops_for(family: str) -> tuple[str, ...]:
    """The paths to drop of a family; an exempt one isn't dropped."""
    return tuple(p for p in DROPS.get(family, ()) if p not in exempt_for(family))
